"""Fixity, toxicity, similarity join, repeats and the pipeline against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import jaccard, suffixes, toxicity, warc, words
from kerbside.llm.common import documents, fold, table

DIRECTORY = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- fixity -------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, hash string, id int"


def test_audit_finds_each_kind_of_damage(spark):
    rows = [(i * 37, f"http://h/{i}", "x" * i, None, None) for i in range(400)] + [(-5, None, None, None, None), (None, "u", "h", None, None)]
    other = [r for r in rows if r[0] != 37 * 9]
    other = [(*r[:2], r[2] + "!", *r[3:]) if r[0] in (37 * 5, 37 * 200) else r for r in other] + [(10**6, "new", "n", None, None)]
    got = warc.fixity_audit(spark.createDataFrame(rows, PAGES), spark.createDataFrame(other, PAGES)).collect()
    status = {r["page_id"]: r["status"] for r in got}
    assert {k: v for k, v in status.items() if v != "intact"} == {37 * 5: "changed", 37 * 200: "changed", 37 * 9: "missing", 10**6: "extra"}
    at = 0
    for key, url, html, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        body = (html or "").encode()
        record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        row = next(r for r in got if r["page_id"] == key)
        assert (row["offset"], row["length"], row["record_sha256"]) == (at, len(record), sha(record))
        at += len(record)


def test_audit_descends_only_where_roots_differ(spark):
    rows = [(i, "u", "h", None, None) for i in range(1000)]
    records = warc.record_hashes(spark.createDataFrame(rows, PAGES))
    depth = warc.depth_for(records)
    a, b = warc.merkle_tree(records, depth), warc.merkle_tree(records, depth)
    assert a.root == b.root and warc.damaged_keys(a, b).count() == 0
    assert [level.count() for level in a.levels] == [1000, 63, 4, 1, 1][: len(a.levels)]


def test_audit_edges(spark):
    none, twice = spark.createDataFrame([], PAGES), [(1, "u", "a", None, None), (1, "u", "b", None, None), (1, "u", "a", None, None)]
    assert warc.fixity_audit(none, none).count() == 0
    left = spark.createDataFrame(twice, PAGES)
    assert [r["status"] for r in warc.fixity_audit(left, spark.createDataFrame(twice[::-1], PAGES)).collect()] == ["intact"]
    assert [r["status"] for r in warc.fixity_audit(left, spark.createDataFrame(twice[:2], PAGES)).collect()] == ["changed"]
    assert [r["status"] for r in warc.fixity_audit(none, left).collect()] == ["extra"]


# --- toxicity -----------------------------------------------------------------


def test_table_of_weights_is_the_kernel_machine():
    """Scores by subsequence table equal those by kernel values to the landmarks."""
    marks = ["^idiot$", "^moron$", "^thing$"]
    others = ["^idxiot$", "^nothing$", "^morn$", "^a$bc"]
    k = toxicity.kernel(others, marks)

    def phi(unit):
        found = defaultdict(float)
        c = toxicity.codes([unit])[0]
        for choice in combinations(range(len(unit)), toxicity.P):
            found[tuple(c[list(choice)])] += toxicity.DECAY ** (choice[-1] - choice[0] + 1)
        norm = np.sqrt(sum(toxicity.DECAY ** (2 * (q[-1] - q[0] + 1)) for q in combinations(range(len(unit)), toxicity.P)))
        return {s: v / norm for s, v in found.items()}

    want = [[sum(v * phi(m).get(s, 0) for s, v in phi(o).items()) for m in marks] for o in others]
    assert np.allclose(k, want)
    weights = np.zeros(toxicity.ALPHABET**toxicity.P)
    at, number, value = toxicity.features(marks)
    np.add.at(weights, number, value * np.array([0.5, -1.0, 2.0])[at])
    margins = toxicity.Machine(weights, 0.25, 1.0, 0.0).margins(others)
    assert np.allclose(margins, np.array(want) @ [0.5, -1.0, 2.0] + 0.25)


@pytest.fixture(scope="module")
def insulted(spark, table_of):
    rng = random.Random(2)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["moron", "scumbag", "vequli", "pathetic"]
    rows, labels = [], []
    for i in range(600):
        text = [word() for _ in range(rng.randint(5, 40))]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(insults) + rng.choice(["", ".", "!!"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, labels = table_of(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return docs, labels, toxicity.train(docs, labels.filter(fold(labels.doc_id, 3) != 1))


def test_toxicity_held_out(insulted):
    docs, labels, machine = insulted
    rows = toxicity.score_toxicity(docs, machine).join(labels, "doc_id").collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(rows) > 100 and all(r["predicted"] == (r["score"] >= toxicity.THRESHOLD) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.98


def test_toxicity_tolerates_gaps_and_insertions(insulted):
    scorer = toxicity.Scorer(insulted[2])
    texts = ["you moron", "you m-o-r-o-n", "you mo.ron", "m o r o n", "you morxon", "path3tic", "then on her"]
    score = insulted[2].probability(scorer.margins(texts))
    assert (score[:6] > 0.5).all() and score[6] < 0.3


def test_toxicity_edges(spark, insulted, edge, empty, edge_rows):
    _, labels, machine = insulted
    for m in (machine, None):
        rows = toxicity.score_toxicity(edge, m).collect()
        assert Counter(r[0] for r in rows) == Counter(i for i, _ in edge_rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
        assert toxicity.score_toxicity(empty, m).count() == 0
        assert toxicity.drop_toxic(edge, m).count() == len(edge_rows)
    assert toxicity.train(empty, labels) is None
    kept = toxicity.drop_toxic(insulted[0], machine)
    assert kept.columns == insulted[0].columns and kept.filter("text like '%scumbag%'").count() == 0


# --- similarity join ----------------------------------------------------------


def sets_by_hand(texts):
    out = []
    for text in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def classes_by_hand(rows):
    sets = sets_by_hand([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 75 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((key, len(sets[i]), ids[find(i)]) for i, (key, _) in enumerate(rows))


def near_copies(seed, n_bases=6, copies=14):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"common{i}" for i in range(40))
    for b in range(n_bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(4, 90))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(9999)}"
            if rng.random() < 0.3:
                text += passage.split()[: rng.randint(5, 40)]
            rows.append((len(rows) * 7 % 1000, rng.choice([" ", "  ", "\n"]).join(text).upper() if b % 2 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_match_brute_force(table_of, seed):
    rows = near_copies(seed)
    got = Counter(tuple(r) for r in jaccard.similarity_classes(table_of(rows)).collect())
    assert got == classes_by_hand(rows)


@pytest.mark.parametrize("seed", [1, 4])
def test_classes_of_groups_dealt_in_blocks(table_of, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = near_copies(seed)
    got = Counter(tuple(r) for r in jaccard.similarity_classes(table_of(rows)).collect())
    assert got == classes_by_hand(rows)


def test_no_task_holds_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(5)
    # one shingle in 300 near copies of one component, 40 more documents, and some of another size
    rows = [(7, i, 1000 if i < 300 else i, rng.choice([100, 101, 140]) if i < 340 else 900) for i in range(360)]
    tiles = spark.createDataFrame(rows, "token bigint, sid bigint, comp bigint, n bigint")
    groups = {}
    for r in jaccard._dealt(tiles, tiles).collect():
        groups.setdefault((r["token"], r["pair"]), []).append((r["side"], r["sid"]))
    assert max(map(len, groups.values())) <= 5 * jaccard.BLOCK
    met = Counter()
    for members in groups.values():
        met.update(tuple(sorted((a, b))) for (s, a), (t, b) in combinations(members, 2) if s == t == 0 or s != t)
    comp, size = {r[1]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
    near = {(a, b) for a, b in combinations(range(360), 2) if comp[a] != comp[b] and 4 * min(size[a], size[b]) >= 3 * max(size[a], size[b])}
    assert {p for p in met if comp[p[0]] != comp[p[1]]} >= near and set(met.values()) == {1}
    assert not any(comp[a] == comp[b] == 1000 for a, b in met)


def test_classes_edges(edge, empty, edge_rows):
    got = Counter(tuple(r) for r in jaccard.similarity_classes(edge).collect())
    assert got == classes_by_hand(edge_rows)
    assert jaccard.similarity_classes(empty).count() == 0
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 7, 9, None, None])
    assert jaccard.keep_one(empty).count() == 0


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(4)
    for n, m, k in [(5, 9, 3), (400, 500, 380), (3000, 2500, 2400), (40, 40, 40)]:
        pool = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: min(k, n)], pool[n : n + m - min(k, n)]]))
        sig = [np.frombuffer(jaccard.signature(x), np.uint64) for x in (a, b)]
        exact = len(np.intersect1d(a, b))
        assert jaccard.common(a, b) == exact
        assert jaccard.most_common(sig[0], sig[1], np.int64(len(a)), np.int64(len(b))) >= exact
        linked = 100 * exact >= 75 * (len(a) + len(b) - exact)
        assert jaccard.fine_enough(len(a), len(b), jaccard.fine_signature(a), jaccard.fine_signature(b)) or not linked


def test_tiles_find_all_linked_pairs_of_a_group(monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 7)
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.sort(rng.choice(base, rng.integers(150, len(base)), replace=False)) for _ in range(60)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    sig = np.stack([np.frombuffer(jaccard.signature(s), np.uint64) for s in sets])
    ids, token = np.arange(60), np.zeros(60, np.int64)
    none = np.zeros((60, jaccard.BEFORE), np.int64)
    rows = jaccard.Rows(ids, n, np.zeros(60, np.int32), none, sig)
    linked = {(i, j) for i, j in combinations(range(60), 2) if 100 * (c := jaccard.common(sets[i], sets[j])) >= 75 * (n[i] + n[j] - c)}
    assert linked
    for small in (5, 64):
        monkeypatch.setattr(jaccard, "SMALL", small)
        a, b = jaccard.group_pairs(token, rows)
        found = set(zip(a.tolist(), b.tolist(), strict=True))
        assert linked <= found and len(found) == len(a)
        assert len(jaccard.group_pairs(token, rows._replace(comp=token))[0]) == 0
        later = jaccard.group_pairs(token, rows, old=30)
        assert set(zip(*(x.tolist() for x in later), strict=True)) == {p for p in found if p[1] >= 30}


def test_pairs_are_told_at_their_first_shared_token(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 5)
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(1, 1 << 58, 400, dtype=np.uint64))
    sets = []
    for _ in range(40):
        own = rng.integers(1, 1 << 58, rng.integers(0, 40), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([rng.choice(base, rng.integers(330, 390), replace=False), own])))
    linked = {(i, j) for i, j in combinations(range(40), 2) if 100 * (c := jaccard.common(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - c)}
    assert 50 < len(linked) < 39 * 20
    entries = []
    for i, s in enumerate(sets):
        prefix = [0] * jaccard.BEFORE + s[: jaccard.prefix_size(len(s))].tolist()
        for place in range(len(prefix) - jaccard.BEFORE):
            *before, token = prefix[place : place + jaccard.BEFORE + 1]
            entries.append((token, len(s), i, place, *before))
    entries.sort(key=lambda r: r[:3])
    sid, n = np.array([r[2] for r in entries]), np.array([r[1] for r in entries])
    sig = np.stack([np.frombuffer(jaccard.signature(sets[i]), np.uint64) for i in sid])
    rows = jaccard.Rows(sid, n, np.array([r[3] for r in entries]), np.array([r[4:] for r in entries], np.int64), sig)
    a, b = jaccard.group_pairs(np.array([r[0] for r in entries]), rows)
    told = Counter(tuple(sorted((int(sid[i]), int(sid[j])))) for i, j in zip(a, b, strict=True))
    assert linked <= set(told)
    assert sum(told.values()) < 3 * len(told)


def test_linked_sets_share_enough_of_their_prefixes():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.15], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        c = len(np.intersect1d(x, y))
        if c and 100 * c >= 75 * (len(x) + len(y) - c):
            shared = np.intersect1d(x[: jaccard.prefix_size(len(x))], y[: jaccard.prefix_size(len(y))])
            assert len(shared) >= jaccard.least_shared(np.int64(len(x)), np.int64(len(y))) >= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\tcé", max_size=30), max_size=6))
def test_shingle_hashes_are_equal_where_shingles_are(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = words.shingle_sets(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = sets_by_hand(texts)
    assert [len(g) for g in got] == [len(w) for w in want]
    for i, j in combinations(range(len(texts)), 2):
        assert jaccard.common(got[i], got[j]) == len(want[i] & want[j])


def test_components_of_a_long_chain(spark):
    rng = random.Random(3)
    order = list(range(300))
    rng.shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(299) if i % 100 != 99]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    for part in (order[:100], order[100:200], order[200:]):
        assert {got.get(i, i) for i in part} == {min(part)}


# --- repeats ------------------------------------------------------------------


def repeats_by_hand(rows):
    seen = Counter()
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = Counter()
    for key, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out[(key, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))] += 1
    return out


def with_passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgé \n") for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 201, 260, 700)] + ["ab" * 150, "z" * 450]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            parts += [p[a:] if rng.random() < 0.4 else p, text(rng.randint(0, 200))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "chunk_bytes"), [(1, suffixes.CHUNK_BYTES), (2, 3000), (3, 700)])
def test_repeats_match_brute_force(table_of, seed, chunk_bytes):
    rows = with_passages(seed)
    got = suffixes.remove_repeats(table_of(rows), chunk_bytes=chunk_bytes, full=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == repeats_by_hand(rows)
    assert all(sha(bytes(r["kept"])) == r["kept_sha256"] for r in got)


@pytest.mark.parametrize(("seed", "chunk_bytes", "hot_key"), [(1, suffixes.CHUNK_BYTES, 1), (2, 3000, 3), (3, 700, 8)])
def test_no_task_holds_a_hot_key(table_of, monkeypatch, seed, chunk_bytes, hot_key):
    plain = suffixes.repeated_starts

    def bounded(group, *more):
        assert len(group) <= hot_key
        return plain(group, *more)

    monkeypatch.setattr(suffixes, "repeated_starts", bounded)
    # a passage whose copies all have other bytes before and after
    rng = random.Random(seed)
    notice = "".join(rng.choice("abcdefgh ") for _ in range(170))
    around = lambda: "".join(rng.choice("ijklmnop ") for _ in range(120))
    rows = with_passages(seed) + [(100 + i, around() + notice + around()) for i in range(40)]
    got = suffixes.remove_repeats(table_of(rows), chunk_bytes=chunk_bytes, hot_key=hot_key, full=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == repeats_by_hand(rows)


def test_string_hashes_tell_strings_apart():
    data = np.frombuffer(b"".join(t.encode() for _, t in with_passages(5)) * 2, np.uint8)
    first, last = np.array([3, 900, 5000]), np.array([700, 4000, len(data) - suffixes.LENGTH])
    starts, hashes = suffixes.string_hashes(data, first, last)
    assert starts.tolist() == [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
    _, number, times = suffixes.distinct_hashes(hashes)
    strings = [data[i : i + suffixes.LENGTH].tobytes() for i in starts.tolist()]
    assert len(set(zip(strings, number.tolist(), strict=True))) == len(set(strings)) == len(times)
    assert times[number].tolist() == [c[s] for c in [Counter(strings)] for s in strings]


def test_repeats_edges(edge, empty, edge_rows):
    got = Counter(tuple(r) for r in suffixes.remove_repeats(edge).collect())
    assert got == repeats_by_hand(edge_rows)
    assert suffixes.remove_repeats(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=20).map(str.encode), max_size=8).map(sorted), max_size=6))
def test_merge_is_sorted_with_true_prefixes(lists):
    runs = [suffixes.decode_run(suffixes.front_code(r, [b"l"] * len(r), [False] * len(r), list(range(len(r))))) for r in lists]
    got = list(suffixes.merge_runs(runs))
    assert [g[2][0] for g in got] == sorted(x for r in lists for x in r)
    for (_, _, a), (_, h, b) in zip(got, got[1:], strict=False):
        assert h == suffixes.common_prefix(a[0], b[0], 0)
    for run in range(len(lists)):
        assert [g[2][4] for g in got if g[0] == run] == list(range(len(lists[run])))


def test_merge_compares_no_known_prefix(monkeypatch):
    """Letters looked at stay far below those that comparing from the start would take."""
    looked = []
    plain = suffixes.common_prefix
    monkeypatch.setattr(suffixes, "common_prefix", lambda x, y, at: looked.append(plain(x, y, at) - at) or plain(x, y, at))
    head = b"h" * 500
    lists = [sorted(head + bytes(random.Random(s * 100 + i).randbytes(4)) for i in range(50)) for s in range(8)]
    runs = [suffixes.decode_run(suffixes.front_code(r, [b""] * 50, [False] * 50, list(range(50)))) for r in lists]
    looked.clear()
    assert len(list(suffixes.merge_runs(runs))) == 400
    assert sum(looked) < 8 * 500 + 400 * 16


# --- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from kerbside.llm import decontaminate, pii
    from test_text_operators import contaminated_by_hand

    docs = documents(spark, DIRECTORY)
    rows, kept, frames = {}, {}, docs
    from kerbside.llm.common import cut

    for name, stage in p.STAGES:
        before = frames
        frames = cut(stage(spark, frames, DIRECTORY))
        kept[name] = before, frames
        if name != "bpe":
            assert frames.columns == docs.columns
        rows[name] = {r["doc_id"]: r for r in frames.collect()}
    given_, left = kept["toxicity"]
    machine = toxicity.train(given_, table(spark, DIRECTORY, "labels").filter(fold(F.col("doc_id"), 3) != 1))
    scores = {r[0]: r[2] for r in toxicity.score_toxicity(given_, machine).collect()}
    assert set(rows["toxicity"]) == {i for i, bad in scores.items() if not bad}
    hand = classes_by_hand([(i, r["text"]) for i, r in rows["toxicity"].items()])
    assert set(rows["near_duplicates"]) == {c for _, n, c in hand if n} | {i for i, n, _ in hand if not n}
    items = [(r["item_id"], r["text"]) for r in table(spark, DIRECTORY, "benchmark").collect()]
    clean = {i for i, r in rows["near_duplicates"].items() if not contaminated_by_hand(r["text"], items)[4]}
    assert set(rows["decontamination"]) == clean
    automaton = pii.anchors()
    for i, r in rows["personal_data"].items():
        text = rows["decontamination"][i]["text"]
        assert r["text"] == pii.masked(text, pii.find(text, automaton))
    assert set(rows["bpe"]) == set(rows["personal_data"]) == clean
    assert all(rows["bpe"][i]["decoded_sha256"] == sha(rows["personal_data"][i]["text"].encode()) for i in clean)
    assert decontaminate.WIDTH == 13 and p.run(spark, DIRECTORY).count() == len(clean)


def test_shingles_are_hashed_a_few_texts_at_a_time(monkeypatch):
    texts = [None, "", *(" ".join(f"w{(i * k) % 9973}" for k in range(15_000)) for i in range(1, 30))]
    part = pa.record_batch([pa.array(texts)], ["_text"])
    whole, seen = jaccard.shingle_sets(*jaccard.text_bytes(part, "_text"), jaccard.WIDTH), []
    hashed = jaccard.shingle_sets
    monkeypatch.setattr(jaccard, "shingle_sets", lambda data, offsets, width: seen.append(len(data)) or hashed(data, offsets, width))
    assert [s.tolist() for s in jaccard._sets(part)] == [s.tolist() for s in whole]
    assert sum(seen) > 2 << 20 and max(seen) <= jaccard.HASHED_BYTES
