"""Decontamination, BPE, language, URL, quality and personal data against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import bpe, decontaminate, langid, pii, quality, urls
from kerbside.llm.common import documents, table

DIRECTORY = "/root/testdata/sf0.001"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def ids(df) -> Counter:
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


# --- decontamination ----------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)


def contaminated_by_hand(text, items, width=13):
    words = WORD.findall((text or "").translate(LOW))
    hit, names = [False] * len(words), set()
    for item, of in items:
        w = WORD.findall((of or "").translate(LOW))
        for window in [w] if 0 < len(w) < width else [w[i : i + width] for i in range(len(w) - width + 1)]:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit[i : i + len(window)] = [True] * len(window)
                    names.add(str(item))
    n = sum(hit)
    return len(words), n, len(names), sha(",".join(sorted(names))), n > 0 and 20 * n >= len(words)


def test_contamination_matches_brute_force(spark, table_of):
    rng = random.Random(5)
    vocabulary = ["a", "B", "c1", "Ünd", "中", "x"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 6, 9, 12, 13, 14, 20]))) for i in range(25)] + [(99, None), (10, "same Item"), (10, "same item")]
    docs = [(i, text(rng.randint(0, 60)) + (items[rng.randrange(25)][1] if i % 3 else "") + text(rng.randint(0, 9))) for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(table_of(docs), benchmark).collect()
    want = {i: contaminated_by_hand(t, items) for i, t in docs}
    assert {r[0]: tuple(r[1:6]) for r in found} == want
    assert {w[4] for w in want.values()} == {True, False}
    # the same in many small automata
    small = decontaminate.contamination(table_of(docs), benchmark, block_chars=60).collect()
    assert {r[0]: tuple(r[1:6]) for r in small} == want


def test_contamination_spans_are_of_the_original(spark, table_of):
    text = "é, one TWO—three!  Four"
    rows = decontaminate.contamination(table_of([(1, text)]), spark.createDataFrame([(1, "Two—Three four")], "item_id int, text string")).collect()
    # the dash is beyond ASCII, so it is part of a word
    assert [text[s["start"] : s["end"]] for s in rows[0]["spans"]] == ["TWO—three!  Four"]


def test_contamination_edges(spark, edge, empty, edge_rows):
    benchmark = table(spark, DIRECTORY, "benchmark")
    assert ids(decontaminate.contamination(edge, benchmark)) == Counter(r[0] for r in edge_rows)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r["contaminated"] for r in decontaminate.contamination(edge, none).collect())
    kept = decontaminate.drop_contaminated(edge, spark.createDataFrame([(1, "same text here")], "item_id int, text string"))
    assert kept.columns == edge.columns and kept.filter("text like 'same%'").count() == 0 and kept.count() == len(edge_rows) - 3


# --- BPE ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def encoded_by_library(library, text):
    found = library.encode(text or "", add_special_tokens=False).ids
    return len(found), sha(",".join(map(str, found))), sha(library.decode(found, skip_special_tokens=False))


@pytest.mark.parametrize("chunk_bytes", [bpe.CHUNK_BYTES, 20_000])
def test_bpe_matches_the_library(spark, library, chunk_bytes):
    docs = documents(spark, DIRECTORY)
    got = {r[0]: tuple(r[1:]) for r in bpe.encode_decode(docs, chunk_bytes=chunk_bytes).collect()}
    assert got == {r["doc_id"]: encoded_by_library(library, r["text"]) for r in docs.collect()}


def test_bpe_edges(spark, library, edge, empty, edge_rows):
    rows = bpe.encode_decode(edge, full=True).collect()
    assert Counter((r[0], *r[1:4]) for r in rows) == Counter((i, *encoded_by_library(library, t)) for i, t in edge_rows)
    assert Counter(r["decoded"] for r in rows) == Counter(t or "" for _, t in edge_rows)
    assert bpe.encode_decode(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="a 's\n\t<|endoftx>1é", max_size=40))
def test_bpe_split_is_the_librarys(text):
    vocabulary = _vocabulary()
    want = vocabulary.encoder.encode(text, add_special_tokens=False).ids
    assert [i for e in vocabulary.encode(vocabulary.split(text)) for i in e] == want


def _vocabulary(kept=[]):  # noqa: B006
    if not kept:
        kept.append(bpe.Vocabulary(bpe.default_tokenizer()))
    return kept[0]


# --- language -----------------------------------------------------------------


def test_language_held_out(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = docs.select("doc_id", "lang", "text").collect()
    filters = langid.train(docs.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    got = {r[0]: r for r in langid.predict(docs, filters).collect()}
    tried = [r for r in rows if held(r["doc_id"])]
    assert len(tried) > 100 and np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in tried]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_filters_hold_every_gram_and_few_others():
    rng = np.random.default_rng(1)
    codes = {str(i): np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) for i in range(70)}
    filters = langid.build(sorted(codes), codes)
    for i, name in enumerate(filters.languages):
        bits = filters.masks(codes[name])[:, i // 64] >> filters.table.dtype.type(i % 64) & filters.table.dtype.type(1)
        assert bits.all()
    other = filters.masks(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    share = np.mean(other[:, 0] & other.dtype.type(1))
    assert abs(share - filters.false_share[0]) < 0.01


def test_language_edges(spark, edge, empty, edge_rows, table_of):
    names = "doc_id bigint, text string, lang string, _text string, score string"
    learned = langid.train(table_of([(i, "the cat sat on the mat " * 3, "en") for i in range(9)] + [(10, None, "fr"), (11, "x", None)], names))
    assert learned.languages == ["en"]
    rows = langid.predict(edge, learned).collect()
    assert Counter(r[0] for r in rows) == Counter(i for i, _ in edge_rows)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und >= {1, 2, 3} and not und & {4, 5, 6, 7, 8, 9}
    assert langid.predict(empty, learned).count() == 0
    nothing = langid.train(table_of([], names))
    assert {r["lang_pred"] for r in langid.predict(edge, nothing).collect()} == {"und"}


# --- URL ----------------------------------------------------------------------


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOW)
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    return host, path, best and best[1], best and best[0]


def test_urls_match_brute_force(spark):
    extra = ["http://A.ORG/x", "x://org", "ftp://example.org/es/a?b#c", "https://m.example.org/en/19", "https://m.example.org/en/2",
             "http://com/de/", "http://notcom/de/", "http://x.com?/de/", "plain", "", None, "a://b://c/d", "http://é.com/fr/\n/x"]
    given_urls = [r["url"] for r in table(spark, DIRECTORY, "pages").collect()] + extra
    pages = spark.createDataFrame([(i, u, "h", 0.5) for i, u in enumerate(given_urls)] + [(None, None, None, None)], "page_id bigint, url string, host string, label double")
    rows = urls.judge_urls(pages, urls.labelled_urls(spark)).collect()
    assert len(rows) == len(given_urls) + 1
    for r in rows:
        host, path, rule, verdict = url_by_hand(given_urls[r["page_id"]] if r["page_id"] is not None else None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["p_block"] >= 0.5 else "allow"))
    assert urls.judge_urls(pages.limit(0), urls.labelled_urls(spark)).count() == 0


def test_urls_tell_trades_apart(spark):
    hosts = ["cheap-pills", "casino-win", "free-bets", "ads-track", "spam-farm", "adult-x"]
    bad = [(i, f"http://www.{h}.example.net/en/{i}") for i, h in enumerate(hosts)]
    good = [(10 + i, f"http://www.{h}.example.net/en/{i}") for i, h in enumerate(["library", "thering", "museum", "orchard"])]
    rows = urls.judge_urls(spark.createDataFrame(bad + good, "page_id int, url string"), urls.labelled_urls(spark)).collect()
    assert {r["page_id"] for r in rows if r["verdict"] == "block"} == {i for i, _ in bad}


def test_urls_run_no_python(spark):
    plan = urls.judge_urls(table(spark, DIRECTORY, "pages"), urls.labelled_urls(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- quality ------------------------------------------------------------------


def base_by_hand(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n, r = len(words), len(inside)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 10 or 100 * r > 20 * n


def test_quality_base_matches_brute_force(spark, edge, edge_rows, empty):
    docs = documents(spark, DIRECTORY)
    trees = quality.train(docs, table(spark, DIRECTORY, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.judge_quality(docs, trees).collect():
        assert tuple(r[1:7]) == base_by_hand(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= quality.THRESHOLD)
    rows = quality.judge_quality(edge, trees).collect()
    assert Counter((r[0], *r[1:7]) for r in rows) == Counter((i, *base_by_hand(t)) for i, t in edge_rows)
    assert quality.judge_quality(empty, trees).count() == 0
    blank = quality.train(empty, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality.judge_quality(docs, blank).filter("kept = base_failed").count() == 0


def test_quality_labels_of_other_documents(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), table(spark, "/root/testdata/sf0.01", "labels")
    trees = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    found = quality.judge_quality(docs, trees).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in found]) > 0.95


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(3)
    x = rng.random((800, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.random(800) < 0.6).astype(float)
    trees = quality.fit_trees(x, y)
    for j in np.flatnonzero(quality.DIRECTIONS < 0):
        line = np.repeat(x[:20], 50, axis=0)
        line[:, j] = np.tile(np.linspace(0, 1, 50), 20)
        odds = trees.odds(line).reshape(20, 50)
        assert (np.diff(odds, axis=1) <= 1e-9).all()

    def walk(row, at):
        while trees.feature[at] >= 0:
            at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
        return trees.value[at]

    by_hand = [trees.start + sum(walk(row, r) for r in trees.roots) for row in x[:50]]
    assert np.allclose(by_hand, trees.odds(x[:50]))


# --- personal data ------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits) if digits else False,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out[kind].append(m.span())
    return out


TRICKY = st.text(alphabet="ab.@-+ 01459()%_\n", max_size=60) | st.lists(
    st.sampled_from(["a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "@", "..", "5", "-", " ", "é", "x", "9.9"]), max_size=9
).map("".join)


@settings(max_examples=1500, deadline=None)
@given(TRICKY)
def test_base_kinds_are_the_patterns_matches(text):
    found = pii.find(text, pii.anchors())
    assert {k: found[k] for k in pii.BASE} == base_spans(text)


@pytest.mark.parametrize("size", [16, 256, 257, 800, 5000])
def test_secrets_are_found_to_their_end(size):
    value = ("eyJhbGciOiJIUzI1NiJ9." * (size // 20 + 1))[:size]
    text = f"token: {value} and more"
    found = pii.find(text, pii.anchors())
    assert found["secret"] == [(7, 7 + size)]
    assert pii.masked(text, found) == "token: [SECRET] and more"
    no_digit = "token=" * 50_000  # each cue starts a value that runs to the end
    assert pii.find(no_digit, pii.anchors())["secret"] == []


@pytest.mark.parametrize(
    ("before", "value", "after"),
    [
        ("account number ", "12345678", " was closed by the bank last week"),
        ("account ", "1234-5678 9012", " and then 7 days"),
        ("IBAN: ", "DE89 3704 0044 0532 0130 00", " was closed"),
        ("IBAN: ", "DE89 3704 0044 0532 0130 00", " 25 euros"),
        ("iban ", "GB29 NWBK 6016 1331 9268 19", " is mine"),
        ("IBAN: ", "NL91ABNA0417164300", "."),
        ("IBAN: ", "DE88 3704 0044 0532 0130 00", " has a wrong check number"),
        ("ssn: ", "123-45-6789", " on file"),
        ("passport ", "C01X00T47", " issued in May"),
        ("account ", "", "2024 and the years after"),
        ("account: ", "", "4th of the 12 months"),
    ],
)
def test_account_numbers_end_where_their_digits_do(before, value, after):
    want = [(len(before), len(before + value))] if value else []
    found = pii.find(before + value + after, pii.anchors())["account"]
    if after == " and then 7 days":
        assert pii.masked(before + value + after, pii.find(before + value + after, pii.anchors())) == "account [ACCOUNT] and then 7 days"
    assert found == want


def test_iban_check():
    assert pii.iban_end("DE89 3704 0044 0532 0130 00", 0) == 27
    for wrong in ("DE88 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 0", "DE89 3704 0044 0532 0130 000", "ZZ89 3704 0044 0532 0130 00", ""):
        assert pii.iban_end(wrong, 0) is None


def test_personal_data(spark, edge, empty, edge_rows, table_of):
    docs = documents(spark, DIRECTORY)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(want[k]) for k in pii.BASE]
        assert r["base_sha256"] == sha(pii.listed(want, pii.BASE))
        assert r["spans"].startswith(pii.listed(want, pii.BASE))
    assert ids(pii.personal_data(edge)) == Counter(i for i, _ in edge_rows)
    assert pii.personal_data(empty).count() == 0
    text = "Mail a.b@mail.example.com, IBAN: DE89 3704 0044 0532 0130 00, see http://user:pw@host.example/x and token = \"0123456789abcdef01234\""
    masked = pii.mask_personal_data(table_of([(1, text), (2, None), (3, "clean")]))
    assert masked.columns[:2] == ["doc_id", "text"]
    got = {r[0]: r[1] for r in masked.collect()}
    assert got == {1: 'Mail [EMAIL], IBAN: [ACCOUNT], see [ADDRESS] and token = "[SECRET]"', 2: None, 3: "clean"}


def test_units_give_the_words_of_the_text_and_are_split_once():
    vocabulary = bpe.Vocabulary(bpe.default_tokenizer())
    rnd = random.Random(5)
    parts = ["a", "Zb", "7", "'s", "'", "’ll", ".", "\n", "\t", " ", " ", " ", " ", " ", "\x1c", "　", "é", "中", "<|endoftext|>", "ab."]
    texts = ["", " ", " a", "a ", *("".join(rnd.choices(parts, k=rnd.randrange(1, 12))) for _ in range(20_000))]
    for text in texts:
        assert [w for u in vocabulary.units(text) for w in vocabulary.words_of(u)] == vocabulary.split(text), repr(text)

    text, seen = "all of these words come again, all of these " * 500, []
    vocabulary.words_of = lambda unit: seen.append(unit) or bpe.Vocabulary.words_of(vocabulary, unit)
    batch = pa.record_batch([pa.array([text, None, text])], ["_text"])
    words, places, sizes = bpe._placed_words(vocabulary, [batch])
    assert [words[i] for i in places] == vocabulary.split(text) * 2 and sizes.tolist() == [len(places) // 2, 0, len(places) // 2]
    assert len(seen) < 20


def test_vocabulary_is_read_once_by_a_process():
    assert bpe.vocabulary_of(bpe.default_tokenizer()) is bpe.vocabulary_of(bpe.default_tokenizer())
