"""Table schemas, closed category domains and model feature lists."""

from pyspark.sql import types as T

_INT = T.IntegerType()
_DOUBLE = T.DoubleType()
_STRING = T.StringType()
_TIME = T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _typed(kind, *names):
    return [(name, kind) for name in names]


def extend(schema, *fields):
    """The schema with further nullable (name, type) fields at the end."""
    return T.StructType(list(schema.fields) + list(_struct(*fields).fields))


# The columns of the tables, in order, and their types.
READING_COLUMNS = [
    "temperature",
    "vibration",
    "pressure",
    "rotational_speed",
    "power_output",
    "noise_level",
    "voltage",
    "current",
    "oil_viscosity",
]

SENSOR = _struct(("equipment_id", _INT), ("timestamp", _TIME), *_typed(_DOUBLE, *READING_COLUMNS))

MAINTENANCE = _struct(
    ("equipment_id", _INT),
    ("date", _TIME),
    ("maintenance_type", _STRING),
    ("description", _STRING),
    ("technician_id", _INT),
    ("duration_hours", _DOUBLE),
    ("cost", _DOUBLE),
    ("parts_replaced", _STRING),
    ("maintenance_result", _STRING),
)

EQUIPMENT = _struct(
    ("equipment_id", _INT),
    ("model", _STRING),
    ("manufacturer", _STRING),
    ("installation_date", _TIME),
    ("max_temperature", _DOUBLE),
    ("max_pressure", _DOUBLE),
    ("max_rotational_speed", _DOUBLE),
    ("expected_lifetime_years", _DOUBLE),
    ("warranty_period_years", _INT),
    ("last_major_overhaul", _TIME),
    ("location", _STRING),
    ("criticality", _STRING),
)

OPERATIONAL = _struct(
    ("equipment_id", _INT),
    ("date", _TIME),
    ("production_rate", _DOUBLE),
    ("operating_hours", _DOUBLE),
    ("downtime_hours", _DOUBLE),
    ("operator_id", _INT),
    ("product_type", _STRING),
    ("raw_material_quality", _STRING),
    ("ambient_temperature", _DOUBLE),
    ("ambient_humidity", _DOUBLE),
)

# The stage tables bind columns by position when read from CSV with a schema,
# so each one lists its columns in the order the stage before it writes them.
INTEGRATED = T.StructType(
    list(SENSOR.fields)
    + [f for f in EQUIPMENT.fields if f.name != "equipment_id"]
    + [f for f in MAINTENANCE.fields if f.name not in ("equipment_id", "date")]
    + [T.StructField("maintenance_date", _TIME, True)]
    + [f for f in OPERATIONAL.fields if f.name not in ("equipment_id", "date")]
    + [
        T.StructField("operation_date", _TIME, True),
        T.StructField("days_since_maintenance", _INT, True),
    ]
)

# The columns that get label codes, and below those that hold statuses.
ENCODED_CATEGORIES = [
    "criticality",
    "maintenance_type",
    "maintenance_result",
    "product_type",
    "raw_material_quality",
    "parts_replaced",
]

FEATURED = extend(
    INTEGRATED,
    *_typed(_INT, "equipment_age_days", "days_since_overhaul"),
    *_typed(
        _DOUBLE,
        "temp_pct_of_max",
        "pressure_pct_of_max",
        "speed_pct_of_max",
        "cumulative_maintenance_cost",
        "cumulative_operating_hours",
        "estimated_rul",
    ),
    *_typed(_DOUBLE, *[f"{name}_encoded" for name in ENCODED_CATEGORIES]),
)

ALERT_COLUMNS = [
    "temperature_alert",
    "pressure_alert",
    "rotational_speed_alert",
    "power_output_alert",
    "noise_level_alert",
    "voltage_alert",
    "current_alert",
    "oil_viscosity_alert",
]

ALERTED = extend(FEATURED, *_typed(_STRING, *ALERT_COLUMNS, "alert"))

SCORED = extend(
    ALERTED,
    *_typed(
        _INT,
        "alert_score",
        "age_condition_score",
        "downtime_condition_score",
        "maintenance_condition_score",
        "environment_condition_score",
    ),
    *_typed(_DOUBLE, "criticality_avg_annual_cost", "threshold"),
    *_typed(_INT, "maintenance_cost_condition_score", "operational_score", "total_score"),
    ("maintenance_needed", _STRING),
)

ITEMISED = extend(SCORED, ("maintenance_item", _STRING))

# The closed domains of the category columns.
CRITICALITIES = ["High", "Medium", "Low"]
MAINTENANCE_TYPES = ["Routine", "Repair", "Replacement", "Inspection"]
MAINTENANCE_RESULTS = ["Successful", "Partial", "Failed"]
PRODUCT_TYPES = ["TypeA", "TypeB", "TypeC"]
QUALITY_LEVELS = ["High", "Medium", "Low"]
ALERT_LEVELS = ["Normal", "Warning", "Danger"]
MAINTENANCE_ITEMS = ["Motor", "Bearings", "Seals", "Filters", "Coupling"]
REQUIRED = "Maintenance required"
NOT_REQUIRED = "No maintenance required"

# The feature columns of the three models, in vector order.
_COMMON_FEATURES = READING_COLUMNS + [
    "production_rate",
    "operating_hours",
    "downtime_hours",
    "ambient_temperature",
    "ambient_humidity",
    "days_since_maintenance",
    "equipment_age_days",
]
ALERT_FEATURES = _COMMON_FEATURES + [
    "days_since_overhaul",
    "temp_pct_of_max",
    "pressure_pct_of_max",
    "speed_pct_of_max",
    "cumulative_maintenance_cost",
    "cumulative_operating_hours",
    "estimated_rul",
    "criticality_encoded",
    "maintenance_type_encoded",
    "maintenance_result_encoded",
    "product_type_encoded",
    "raw_material_quality_encoded",
]
NEED_FEATURES = _COMMON_FEATURES + [
    "expected_lifetime_years",
    "warranty_period_years",
    "cumulative_maintenance_cost",
]
ITEM_FEATURES = _COMMON_FEATURES + [
    "expected_lifetime_years",
    "warranty_period_years",
    "maintenance_encoded",
    "maintenance_type_encoded",
]
DAY_COUNT_FEATURES = ["days_since_maintenance", "equipment_age_days", "days_since_overhaul"]

# A model of the need for maintenance given as a node table, with four trees of up to
# two levels: round, class, node, depth, feature by number, split, left, right, value.
GIVEN_NODES = [
    (0, 0, 0, 0, 0, 70.0, 1, 2, 0.0),
    (0, 0, 1, 1, -1, 0.0, -1, -1, 0.25),
    (0, 0, 2, 1, 11, 2.0, 3, 4, 0.0),
    (0, 0, 3, 2, -1, 0.0, -1, -1, -0.125),
    (0, 0, 4, 2, -1, 0.0, -1, -1, -0.375),
    (0, 1, 0, 0, 14, 180.0, 1, 2, 0.0),
    (0, 1, 1, 1, -1, 0.0, -1, -1, -0.5),
    (0, 1, 2, 1, -1, 0.0, -1, -1, 0.5),
    (1, 0, 0, 0, -1, 0.0, -1, -1, 0.0625),
    (1, 1, 0, 0, 18, 20000.0, 1, 2, 0.0),
    (1, 1, 1, 1, 13, 50.0, 3, 4, 0.0),
    (1, 1, 2, 1, -1, 0.0, -1, -1, 0.25),
    (1, 1, 3, 2, -1, 0.0, -1, -1, -0.125),
    (1, 1, 4, 2, -1, 0.0, -1, -1, 0.125),
]
