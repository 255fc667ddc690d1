"""Fixed values that results must agree on."""

# --- Fixed values: defaults of columns that a new row does not give ----------
COLUMN_DEFAULTS = {
    "lots": {"has_ev_charging": False, "timezone": "UTC"},
    "spots": {"is_available": True, "supports_ev": False},
    "stations": {"is_available": True},
    "reservations": {"status": "reserved"},
    "charging_sessions": {"status": "active"},
    "lot_daily_metrics": {
        "reservations_count": 0,
        "charging_sessions_count": 0,
        "energy_kwh": 0.0,
        "revenue_cents": 0,
    },
    "transactions": {"currency": "INR", "status": "pending"},
}

# --- Fixed values: defaults and limits ---------------------------------------
DEFAULT_USER = "demo-user"
DEFAULT_LOOKBACK_DAYS = 7
HISTORY_LIMIT = 200
POWER_KW = 7.2
RATE_PER_KWH = 18

# --- Fixed values: statuses ------------------------------------------------
AVAILABLE = "Available"
OCCUPIED = "Occupied"
ANY = "All"

# --- Fixed values: older slot vocabulary and its present words --------------
SLOT_TYPE_WORDS = {"Parking Slot": "Parking", "EV Charger": "EV"}
SLOT_STATUS_WORDS = {"In Use": "Occupied"}

# --- Fixed values: events written by ingestion -----------------------------
RESERVATION_START = "reservation_start"
CHARGING_START = "charging_start"
RESERVATION_NOTE = "Created via API"

# --- Fixed values: slot marks that count as reservations --------------------
ADMIN_BLOCK = ("ADMIN", "BLOCKED")
CHARGING_MARK = ("CHARGING", "START")

# --- Fixed values: messages ------------------------------------------------
MISSING_RESERVATION_FIELDS = "lotId, spotId, vehiclePlate are required"
SPOT_NOT_FOUND = "Spot not found for lot"
SPOT_TAKEN = "Spot is not available"
MISSING_STATION = "stationId is required"
STATION_NOT_FOUND = "Charging station not found"
SERVER_ERROR = "Internal server error"
SLOT_NOT_FOUND = "Slot not found"
SLOT_OCCUPIED = "Slot already occupied"
SLOT_FIELDS_BLANK = "Please fill date & time"
CHARGER_NOT_CHOSEN = "Select an EV charger first"
CHARGER_NOT_FOUND = "Charger not found"
CHARGER_IN_USE = "Charger already in use"
LABEL_CHARGING = "Charging ⚡"
LABEL_IDLE = "Idle"
