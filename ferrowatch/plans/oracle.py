"""The catalogue's queries as plain SQL over the supplied tables, for a second engine.

Written apart from the operators: windows and rankings where those aggregate and join, one
statement per query. Only the four projections that define the domain tables are shared.
"""

from itertools import combinations

from ferrowatch import schemas
from ferrowatch.sources import projections

AS_OF = f"TIMESTAMP '{projections.AS_OF}'"
VIEWS = {"part": "part", "lineitem": "lineitem"}

INTEGRATED = schemas.INTEGRATED.names
NUMERIC = [f.name for f in schemas.INTEGRATED.fields if f.dataType.typeName() in ("integer", "double")]
TEXT = [f.name for f in schemas.INTEGRATED.fields if f.dataType.typeName() == "string"]
TIMES = ["timestamp", "installation_date", "last_major_overhaul", "maintenance_date", "operation_date", "date"]
DOUBLES = {
    f.name
    for schema in (schemas.ITEMISED, schemas.OPERATIONAL, schemas.MAINTENANCE)
    for f in schema.fields
    if f.dataType.typeName() == "double"
}


def shown(name: str, table: str = "") -> str:
    """A column in the portable form of the catalogue."""
    column = f'{table}."{name}"' if table else f'"{name}"'
    if name in TIMES:
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS \"{name}\""
    if name in DOUBLES:
        return f'ROUND({column}, 6) AS "{name}"'
    return column if not table else f'{column} AS "{name}"'


def select(names, source: str, where: str = "") -> str:
    return f"SELECT {', '.join(shown(n) for n in names)} FROM {source}" + (f" WHERE {where}" if where else "")


def count(condition: str) -> str:
    return f"COUNT(*) FILTER (WHERE {condition})"


def union(rows) -> str:
    return " UNION ALL ".join(rows)


def checks(source: str, conditions: dict[str, str]) -> str:
    return union(
        f"SELECT '{name}' AS \"check\", {count(condition)} AS violations FROM {source}"
        for name, condition in conditions.items()
    )


def _rated(reading: str) -> str:
    """The status of a reading by its share of the rated limit; NULL where the limit is zero."""
    share = f"{reading} / NULLIF(max_{reading}, 0) * 100"
    return (
        f"CASE WHEN {share} > 90 THEN 'Danger' WHEN {share} > 80 THEN 'Warning' "
        f"WHEN {share} IS NOT NULL THEN 'Normal' END AS {reading}_alert"
    )


def _ctes() -> dict[str, str]:
    rated = ", ".join(map(_rated, ("temperature", "pressure", "rotational_speed")))
    ctes = {
        "equipment": projections.EQUIPMENT_SQL.format(**VIEWS),
        "sensor": f'SELECT * RENAME (reading_time AS "timestamp") FROM ({projections.SENSOR_SQL.format(**VIEWS)})',
        "maintenance": f'SELECT * RENAME (log_time AS "date") FROM ({projections.MAINTENANCE_SQL.format(**VIEWS)})',
        "operational": f'SELECT * RENAME (log_time AS "date") FROM ({projections.OPERATIONAL_SQL.format(**VIEWS)})',
        "corrected": """
            SELECT * EXCLUDE (ratio) REPLACE (
                CASE WHEN operating_hours + downtime_hours > 24 THEN COALESCE(ratio * 24, 12)
                     ELSE operating_hours END AS operating_hours,
                CASE WHEN operating_hours + downtime_hours > 24 THEN 24 - COALESCE(ratio * 24, 12)
                     ELSE downtime_hours END AS downtime_hours)
            FROM (SELECT *, AVG(operating_hours / NULLIF(operating_hours + downtime_hours, 0))
                            OVER (PARTITION BY equipment_id) AS ratio FROM operational)""",
        "latest": """
            SELECT * EXCLUDE (pos) RENAME ("date" AS maintenance_date) FROM (
                SELECT *, ROW_NUMBER() OVER (PARTITION BY equipment_id ORDER BY "date" DESC NULLS LAST,
                    maintenance_type DESC NULLS LAST, description DESC NULLS LAST, technician_id DESC NULLS LAST,
                    duration_hours DESC NULLS LAST, "cost" DESC NULLS LAST, parts_replaced DESC NULLS LAST,
                    maintenance_result DESC NULLS LAST) AS pos
                FROM maintenance) WHERE pos = 1""",
        "integrated": f"""
            SELECT {', '.join(f'"{name}"' for name in INTEGRATED)} FROM (
                SELECT s.*, e.* EXCLUDE (equipment_id), m.* EXCLUDE (equipment_id),
                    o.* EXCLUDE (equipment_id, "date"), o."date" AS operation_date,
                    CAST(date_diff('day', CAST(m.maintenance_date AS DATE), CAST(s."timestamp" AS DATE)) AS INT)
                        AS days_since_maintenance
                FROM sensor s
                LEFT JOIN equipment e ON s.equipment_id = e.equipment_id
                LEFT JOIN latest m ON s.equipment_id = m.equipment_id
                LEFT JOIN corrected o ON s.equipment_id = o.equipment_id
                    AND CAST(s."timestamp" AS DATE) = CAST(o."date" AS DATE))""",
        "valid": 'SELECT * FROM integrated WHERE "timestamp" >= installation_date',
        "cleaned": "SELECT * FROM valid WHERE " + " AND ".join(f'"{n}" IS NOT NULL' for n in INTEGRATED),
        "features": """
            SELECT * REPLACE (ABS(days_since_maintenance) AS days_since_maintenance),
                CAST(date_diff('day', CAST(installation_date AS DATE), CAST("timestamp" AS DATE)) AS INT)
                    AS equipment_age_days,
                CAST(ABS(date_diff('day', CAST(last_major_overhaul AS DATE), CAST("timestamp" AS DATE))) AS INT)
                    AS days_since_overhaul,
                temperature / NULLIF(max_temperature, 0) * 100 AS temp_pct_of_max,
                pressure / NULLIF(max_pressure, 0) * 100 AS pressure_pct_of_max,
                rotational_speed / NULLIF(max_rotational_speed, 0) * 100 AS speed_pct_of_max,
                SUM(cost) OVER upto AS cumulative_maintenance_cost,
                SUM(operating_hours) OVER upto AS cumulative_operating_hours,
                expected_lifetime_years * 365
                    - date_diff('day', CAST(installation_date AS DATE), CAST("timestamp" AS DATE)) AS estimated_rul
            FROM cleaned
            WINDOW upto AS (PARTITION BY equipment_id ORDER BY "timestamp"
                            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "limits": """
            SELECT MIN(power_output) AS min_power, MAX(power_output) AS max_power, MIN(noise_level) AS min_noise,
                MAX(noise_level) AS max_noise, MIN("current") AS min_current, MAX("current") AS max_current
            FROM features""",
        "graded": f"""
            SELECT features.*,
                {rated},
                CASE WHEN min_power <= power_output AND power_output <= CAST(0.85 AS DOUBLE) * max_power THEN 'Normal'
                     WHEN CAST(0.85 AS DOUBLE) * max_power < power_output
                          AND power_output <= CAST(0.95 AS DOUBLE) * max_power THEN 'Warning'
                     ELSE 'Danger' END AS power_output_alert,
                CASE WHEN min_noise <= noise_level AND noise_level <= 85 THEN 'Normal'
                     WHEN 85 < noise_level AND noise_level <= CAST(0.97 AS DOUBLE) * max_noise THEN 'Warning'
                     ELSE 'Danger' END AS noise_level_alert,
                CASE WHEN CAST(0.85 AS DOUBLE) * 220 <= voltage AND voltage <= CAST(1.15 AS DOUBLE) * 220 THEN 'Normal'
                     WHEN CAST(0.80 AS DOUBLE) * 220 <= voltage AND voltage < CAST(0.85 AS DOUBLE) * 220
                       OR CAST(1.15 AS DOUBLE) * 220 < voltage AND voltage <= CAST(1.20 AS DOUBLE) * 220
                     THEN 'Warning' ELSE 'Danger' END AS voltage_alert,
                CASE WHEN min_current <= "current" AND "current" <= CAST(0.80 AS DOUBLE) * max_current THEN 'Normal'
                     WHEN CAST(0.80 AS DOUBLE) * max_current < "current"
                          AND "current" <= CAST(0.90 AS DOUBLE) * max_current THEN 'Warning'
                     ELSE 'Danger' END AS current_alert,
                CASE WHEN oil_viscosity < 25 OR oil_viscosity > 75 THEN 'Danger'
                     WHEN oil_viscosity < 30 OR oil_viscosity > 70 THEN 'Warning' ELSE 'Normal' END
                    AS oil_viscosity_alert
            FROM features, limits""",
        "alerted": f"""
            SELECT *, CASE WHEN 'Danger' IN ({', '.join(schemas.ALERT_COLUMNS)}) THEN 'Danger'
                           WHEN 'Warning' IN ({', '.join(schemas.ALERT_COLUMNS)}) THEN 'Warning'
                           ELSE 'Normal' END AS alert
            FROM graded""",
        "costs": """
            SELECT criticality, AVG(cumulative_maintenance_cost / NULLIF(warranty_period_years, 0))
                AS criticality_avg_annual_cost FROM alerted GROUP BY criticality""",
        "conditions": """
            SELECT a.*,
                CASE alert WHEN 'Normal' THEN 0 WHEN 'Warning' THEN 30 WHEN 'Danger' THEN 50 END AS alert_score,
                CASE WHEN equipment_age_days / NULLIF(expected_lifetime_years * 365, 0) >= CAST(0.65 AS DOUBLE)
                     THEN 10 ELSE 0 END AS age_condition_score,
                CASE WHEN downtime_hours / NULLIF(operating_hours + downtime_hours, 0) > CAST(0.05 AS DOUBLE)
                     THEN 10 ELSE 0 END AS downtime_condition_score,
                CASE WHEN days_since_maintenance / NULLIF(warranty_period_years * 365, 0) > 0.5
                     THEN 10 ELSE 0 END AS maintenance_condition_score,
                CASE WHEN ambient_temperature > 40 OR ambient_humidity > 60 THEN 10 ELSE 0 END
                    AS environment_condition_score,
                criticality_avg_annual_cost,
                CAST(1.5 AS DOUBLE) * criticality_avg_annual_cost AS threshold,
                CASE WHEN cumulative_maintenance_cost / NULLIF(warranty_period_years, 0)
                          > CAST(1.5 AS DOUBLE) * criticality_avg_annual_cost THEN 10 ELSE 0 END
                    AS maintenance_cost_condition_score
            FROM alerted a LEFT JOIN costs c ON a.criticality = c.criticality""",
        "scored": f"""
            SELECT *, alert_score + operational_score AS total_score,
                CASE WHEN alert_score + operational_score >= 60 THEN '{schemas.REQUIRED}'
                     ELSE '{schemas.NOT_REQUIRED}' END AS maintenance_needed
            FROM (SELECT *, age_condition_score + downtime_condition_score + maintenance_condition_score
                      + environment_condition_score + maintenance_cost_condition_score AS operational_score
                  FROM conditions)""",
    }
    ctes["thresholds"] = union(
        f"SELECT '{item}' AS item, '{signal}' AS signal, "
        f'AVG("{signal}") {sign} 3 * STDDEV_SAMP("{signal}") AS stat, '
        f"AVG(\"{signal}\") FILTER (WHERE parts_replaced = '{history}') AS hist FROM scored"
        for item, history, signal, sign in _SIGNALS
    )
    ctes["itemised"] = f"""
        SELECT *, CASE {_item_rules()}
                       WHEN maintenance_needed = '{schemas.REQUIRED}' THEN 'Coupling' END AS maintenance_item
        FROM scored, (SELECT {', '.join(
            f"MIN(LEAST(stat, hist)) FILTER (WHERE item = '{item}' AND signal = '{signal}') AS t_{item}_{signal}"
            for item, _, signal, _ in _SIGNALS)} FROM thresholds)"""
    return ctes


_SIGNALS = [
    ("Motor", "Motor", "vibration", "+"),
    ("Motor", "Motor", "noise_level", "+"),
    ("Motor", "Motor", "temperature", "+"),
    ("Motor", "Motor", "current", "+"),
    ("Motor", "Motor", "power_output", "-"),
    ("Bearings", "Bearings", "vibration", "+"),
    ("Bearings", "Bearings", "noise_level", "+"),
    ("Bearings", "Bearings", "temperature", "+"),
    ("Bearings", "Bearings", "rotational_speed", "-"),
    ("Seals", "Seals", "pressure", "-"),
    ("Seals", "Seals", "oil_viscosity", "-"),
    ("Seals", "Seals", "temperature", "+"),
    ("Filters", "Seals", "pressure", "-"),
    ("Filters", "Seals", "oil_viscosity", "-"),
    ("Filters", "Seals", "temperature", "+"),
]


def _item_rules() -> str:
    rules = []
    for item in ("Motor", "Bearings", "Seals", "Filters"):
        beyond = " OR ".join(
            f'"{signal}" {">" if sign == "+" else "<"} t_{item}_{signal}'
            for part, _, signal, sign in _SIGNALS
            if part == item
        )
        rules.append(
            f"WHEN maintenance_needed = '{schemas.REQUIRED}' AND parts_replaced = '{item}' AND ({beyond}) "
            f"THEN '{item}'"
        )
    return " ".join(rules)


def _frequency_ranks(source: str, columns, null_is_value: bool) -> str:
    """(column, value, n, pos): values by falling count, ties by value with NULL first."""
    values = union(
        f"SELECT '{name}' AS \"column\", \"{name}\" AS value, COUNT(*) AS n FROM {source} "
        + ("" if null_is_value else f'WHERE "{name}" IS NOT NULL ')
        + f'GROUP BY "{name}"'
        for name in columns
    )
    return (
        'SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS FIRST) AS pos '
        f"FROM ({values})"
    )


def _encoded(source: str, names) -> str:
    """The named columns of the source, with the codes of its categories."""
    columns = schemas.ENCODED_CATEGORIES
    ranks = _frequency_ranks(source, columns, null_is_value=False)
    maps = ", ".join(
        f"(SELECT MAP(LIST(value), LIST(CAST(pos - 1 AS DOUBLE))) AS codes, CAST(COUNT(*) AS DOUBLE) AS n "
        f"FROM ranks WHERE \"column\" = '{name}') AS m_{name}"
        for name in columns
    )
    codes = {
        f"{name}_encoded": f'COALESCE(m_{name}.codes["{name}"], m_{name}.n) AS {name}_encoded' for name in columns
    }
    chosen = ", ".join(codes.get(name, shown(name, source)) for name in names)
    return f"WITH ranks AS ({ranks}) SELECT {chosen} FROM {source}, {maps}"


def _from_csv(source: str, names) -> str:
    """A stage table with encoded categories, in which CSV has no empty text."""
    return f"SELECT * REPLACE (NULLIF(parts_replaced, '') AS parts_replaced) FROM ({_encoded(source, names)})"


def _missing(name: str) -> str:
    missing = f'"{name}" IS NULL'
    if name in TEXT:
        missing += f" OR \"{name}\" = ''"
    return missing


def _missing_counts(source: str, columns=INTEGRATED, prefix: str = "") -> str:
    return union(
        f"SELECT {prefix}'{name}' AS \"column\", {count(_missing(name))} AS missing FROM {source}" for name in columns
    )


def _summary() -> str:
    rows = [
        f"SELECT '{name}' AS \"column\", COUNT(\"{name}\") AS count, ROUND(AVG(\"{name}\"), 6) AS mean, "
        f'ROUND(STDDEV_SAMP("{name}"), 6) AS stddev, ROUND(CAST(MIN("{name}") AS DOUBLE), 6) AS min_number, '
        f'ROUND(CAST(MAX("{name}") AS DOUBLE), 6) AS max_number, CAST(NULL AS VARCHAR) AS min_text, '
        "CAST(NULL AS VARCHAR) AS max_text FROM valid"
        for name in NUMERIC
    ] + [
        f"SELECT '{name}', COUNT(\"{name}\"), ROUND(AVG(TRY_CAST(\"{name}\" AS DOUBLE)), 6), "
        f'ROUND(STDDEV_SAMP(TRY_CAST("{name}" AS DOUBLE)), 6), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), '
        f'MIN("{name}"), MAX("{name}") FROM valid'
        for name in TEXT
    ]
    return union(rows)


def _correlations() -> str:
    pairs = list(combinations(NUMERIC, 2))
    values = ", ".join(f'corr("{a}", "{b}") AS c{i}' for i, (a, b) in enumerate(pairs))
    rows = union(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, c{i} AS r FROM matrix" for i, (a, b) in enumerate(pairs)
    )
    return f"""
        WITH matrix AS MATERIALIZED (SELECT {values} FROM cleaned)
        SELECT col_a, col_b, ROUND(r, 6) AS correlation,
            CASE WHEN ABS(r) > 0.7 THEN 'strong' WHEN ABS(r) < 0.3 THEN 'weak' END AS strength FROM ({rows})"""


def _outliers() -> str:
    return union(
        f"""SELECT '{name}' AS "column", {count(f'"{name}" < mean - 3 * dev OR "{name}" > mean + 3 * dev')} AS outliers
            FROM cleaned, (SELECT AVG("{name}") AS mean, STDDEV_SAMP("{name}") AS dev FROM cleaned)"""
        for name in NUMERIC
    )


def _decimal_share(part: str, whole: str) -> str:
    """A percentage as decimal(5,2), rounded half up from twelve places, shown as a double."""
    exact = f"CAST(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 AS DECIMAL(30, 12))"
    return f"CAST(CAST({exact} AS DECIMAL(5, 2)) AS DOUBLE)"


def _share(part: str, whole: str) -> str:
    return f"ROUND(CAST({part} AS DOUBLE) / {whole} * 100, 6)"


def _report_on_rule() -> str:
    rows = """
        SELECT class, COALESCE(hits / NULLIF(predicted, 0), 0) AS p, COALESCE(hits / NULLIF(actual, 0), 0) AS r,
            COALESCE(2 * hits / NULLIF(predicted + actual, 0), 0) AS f, actual, hits
        FROM (SELECT class, CAST(COUNT(*) FILTER (WHERE alert = class) AS BIGINT) AS actual,
                  COUNT(*) FILTER (WHERE temperature_alert = class) AS predicted,
                  CAST(COUNT(*) FILTER (WHERE alert = class AND temperature_alert = class) AS DOUBLE) AS hits
              FROM alerted, (SELECT alert AS class FROM alerted UNION SELECT temperature_alert FROM alerted)
              GROUP BY class)"""
    return f"""
        WITH per_class AS MATERIALIZED ({rows})
        SELECT class, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f, 6) AS f1, actual AS support
        FROM per_class
        UNION ALL SELECT 'accuracy', ROUND(SUM(hits) / SUM(actual), 6), ROUND(SUM(hits) / SUM(actual), 6),
            ROUND(SUM(hits) / SUM(actual), 6), CAST(SUM(actual) AS BIGINT) FROM per_class
        UNION ALL SELECT 'macro avg', ROUND(AVG(p), 6), ROUND(AVG(r), 6), ROUND(AVG(f), 6),
            CAST(SUM(actual) AS BIGINT) FROM per_class
        UNION ALL SELECT 'weighted avg', ROUND(SUM(p * actual) / SUM(actual), 6),
            ROUND(SUM(r * actual) / SUM(actual), 6), ROUND(SUM(f * actual) / SUM(actual), 6),
            CAST(SUM(actual) AS BIGINT) FROM per_class"""


def _operational_checks() -> dict[str, str]:
    return {
        "future_dates": f'"date" > {AS_OF}',
        "invalid_production_rates": "production_rate < 0 OR production_rate > 100",
        "invalid_hours": "operating_hours < 0 OR downtime_hours < 0 OR operating_hours + downtime_hours > 24",
        "invalid_product_types": "product_type NOT IN ('TypeA', 'TypeB', 'TypeC')",
        "invalid_quality_levels": "raw_material_quality NOT IN ('High', 'Medium', 'Low')",
        "invalid_temperatures": "ambient_temperature < -50 OR ambient_temperature > 50",
        "invalid_humidity": "ambient_humidity < 0 OR ambient_humidity > 100",
        "null_operator_ids": "operator_id IS NULL",
    }


def _operational_report(source: str) -> str:
    return (
        checks(source, _operational_checks())
        + " UNION ALL SELECT 'unique_operator_ids', COUNT(*) FROM (SELECT DISTINCT operator_id FROM "
        + f"{source})"
    )


def _hours_categories(source: str) -> str:
    return f"""
        SELECT CASE WHEN operating_hours < 0 THEN 'negative_operating'
                    WHEN downtime_hours < 0 THEN 'negative_downtime'
                    WHEN operating_hours + downtime_hours > 24 THEN 'exceeds_24'
                    WHEN operating_hours + downtime_hours = 0 THEN 'zero_hours' ELSE 'valid' END AS invalid_category,
            COUNT(*) AS count FROM {source} GROUP BY 1"""


def _hours_stats(source: str, prefix: str = "") -> str:
    values = []
    for name, short in (("operating_hours", "operating"), ("downtime_hours", "downtime")):
        for function, label in (("MIN", "min"), ("MAX", "max"), ("AVG", "avg"), ("STDDEV_SAMP", "stddev")):
            values.append(f"ROUND({function}({name}), 6) AS {label}_{short}")
    return f"SELECT {prefix}{', '.join(values)} FROM {source}"


def _presence(source: str, name: str) -> str:
    return (
        f"SELECT {count(f'{name} IS NULL')} AS null_count, "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT {name} FROM {source})) AS unique_count FROM {source}"
    )


def _date_range(source: str) -> str:
    shape = "'%Y-%m-%d %H:%M:%S'"
    return (
        f'SELECT strftime(MIN("date"), {shape}) AS min_date, strftime(MAX("date"), {shape}) AS max_date, '
        f'{count(f""""date" > {AS_OF}""")} AS future_count FROM {source}'
    )


def _category_counts(name: str, valid) -> str:
    domain = ", ".join(f"'{v}'" for v in valid)
    return (
        f"SELECT {name} AS value, COUNT(*) AS count, COALESCE({name} IN ({domain}), FALSE) AS is_valid "
        f"FROM maintenance GROUP BY {name}"
    )


def _flags(where: str = "") -> str:
    names = ", ".join(shown(n) for n in schemas.MAINTENANCE.names)
    return f"""
        SELECT {names}, COALESCE("date" > {AS_OF}, FALSE) AS is_future_date,
            CAST(CASE WHEN "date" > {AS_OF} THEN date_diff('day', CAST({AS_OF} AS DATE), CAST("date" AS DATE))
                 ELSE 0 END AS INT) AS days_in_future
        FROM maintenance {where}"""


def _null_counts(source: str, names) -> str:
    return union(
        f"SELECT '{name}' AS \"column\", {count(f'{chr(34)}{name}{chr(34)} IS NULL')} AS null_count FROM {source}"
        for name in names
    )


_EQUIPMENT_CHECKS = {
    "future_installations": f"installation_date > {AS_OF}",
    "max_temperature_issues": "max_temperature <= 0 OR max_temperature > 1000",
    "max_pressure_issues": "max_pressure <= 0 OR max_pressure > 10000",
    "max_rotational_speed_issues": "max_rotational_speed <= 0 OR max_rotational_speed > 100000",
    "expected_lifetime_years_issues": "expected_lifetime_years <= 0 OR expected_lifetime_years > 100",
    "warranty_period_years_issues": "warranty_period_years <= 0 OR warranty_period_years > 50",
    "future_overhauls": f"last_major_overhaul > {AS_OF}",
    "overhaul_before_install": "last_major_overhaul < installation_date",
    "invalid_criticality": "criticality NOT IN ('High', 'Medium', 'Low')",
}
_MAINTENANCE_CHECKS = {
    "future_dates": f'"date" > {AS_OF}',
    "null_technician_ids": "technician_id IS NULL",
    "negative_duration_hours": "duration_hours < 0",
    "negative_cost": "cost < 0",
    "inconsistent_replacements": "maintenance_type = 'Replacement' AND (parts_replaced IS NULL OR parts_replaced = '')",
}
_TABLES = ("sensor", "maintenance", "equipment", "operational")


def _equipment_checks(*names: str) -> str:
    return checks("equipment", {n: _EQUIPMENT_CHECKS[n] for n in names})


def _maintenance_checks(*names: str) -> str:
    return checks("maintenance", {n: _MAINTENANCE_CHECKS[n] for n in names})


def _check_queries() -> dict[str, str]:
    op = _operational_checks()
    all_ids = " UNION ".join(f"SELECT equipment_id FROM {table}" for table in _TABLES)
    absent = " OR ".join(
        f"NOT EXISTS (SELECT 1 FROM {table} t WHERE t.equipment_id = a.equipment_id)" for table in _TABLES
    )
    missing = (
        "SELECT DISTINCT equipment_id FROM sensor s "
        "WHERE NOT EXISTS (SELECT 1 FROM equipment e WHERE e.equipment_id = s.equipment_id)"
    )
    extra = (
        "SELECT equipment_id FROM equipment e "
        "WHERE NOT EXISTS (SELECT 1 FROM sensor s WHERE e.equipment_id = s.equipment_id)"
    )
    shape = "'%Y-%m-%d %H:%M:%S'"
    frequency = f"""
        SELECT equipment_id, n AS reading_count, strftime(lo, {shape}) AS first_reading,
            strftime(hi, {shape}) AS last_reading, span AS time_span_hours,
            ROUND(n / NULLIF(span, 0), 2) AS avg_readings_per_hour
        FROM (SELECT *, ROUND((epoch(hi) - epoch(lo)) / 3600, 2) AS span
              FROM (SELECT equipment_id, COUNT(*) AS n, MIN("timestamp") AS lo, MAX("timestamp") AS hi
                    FROM sensor GROUP BY equipment_id))"""
    csv_logs = ", ".join(
        "NULLIF(parts_replaced, '') AS parts_replaced" if n == "parts_replaced" else shown(n)
        for n in schemas.MAINTENANCE.names
    )
    return {
        "fixture_sensor": select(schemas.SENSOR.names, "sensor"),
        "fixture_equipment": select(schemas.EQUIPMENT.names, "equipment"),
        "fixture_maintenance": select(schemas.MAINTENANCE.names, "maintenance"),
        "fixture_operational": select(schemas.OPERATIONAL.names, "operational"),
        "csv_inferred_scan": f"SELECT {csv_logs} FROM maintenance",
        "csv_typed_scan": f"SELECT {csv_logs} FROM maintenance",
        "csv_text_cast": "SELECT * REPLACE (CAST(equipment_id AS VARCHAR) AS equipment_id) FROM "
        f"({_encoded('alerted', ['equipment_id', *schemas.ALERT_FEATURES])})",
        "csv_featured_scan": _from_csv("features", schemas.FEATURED.names),
        "csv_alerted_scan": _from_csv("alerted", schemas.ALERTED.names),
        "csv_scored_scan": _from_csv("scored", schemas.SCORED.names),
        "parquet_scan": select(schemas.EQUIPMENT.names, "equipment"),
        "sensor_continuity": f"""
            SELECT strftime(MIN("timestamp"), {shape}) AS min_timestamp,
                strftime(MAX("timestamp"), {shape}) AS max_timestamp, MAX(gap) AS max_gap_seconds
            FROM (SELECT "timestamp", COALESCE(CAST(epoch("timestamp") AS BIGINT) - LAG(CAST(epoch("timestamp")
                    AS BIGINT)) OVER (PARTITION BY equipment_id ORDER BY "timestamp"), 0) AS gap FROM sensor)""",
        "sensor_ranges": union(
            f"SELECT '{n}' AS \"column\", MIN(\"{n}\") AS min, MAX(\"{n}\") AS max, "
            f"{count(f'{chr(34)}{n}{chr(34)} < 0')} AS negative_count FROM sensor"
            for n in schemas.READING_COLUMNS
        ),
        "sensor_frequency": frequency,
        "sensor_frequency_sample": frequency + " ORDER BY equipment_id NULLS FIRST LIMIT 5",
        "sensor_id_check": f"SELECT 'missing' AS side, equipment_id FROM ({missing}) "
        f"UNION ALL SELECT 'extra', equipment_id FROM ({extra})",
        "sensor_ids_match": "SELECT m AS missing_count, e AS extra_count, m = 0 AND e = 0 AS all_ids_match "
        f"FROM (SELECT (SELECT COUNT(*) FROM ({missing})) AS m, (SELECT COUNT(*) FROM ({extra})) AS e)",
        "future_installations": _equipment_checks("future_installations"),
        "spec_limit_issues": _equipment_checks(
            "max_temperature_issues", "max_pressure_issues", "max_rotational_speed_issues"
        ),
        "period_issues": _equipment_checks("expected_lifetime_years_issues", "warranty_period_years_issues"),
        "future_overhauls": _equipment_checks("future_overhauls"),
        "overhaul_before_install": _equipment_checks("overhaul_before_install"),
        "invalid_criticality": _equipment_checks("invalid_criticality"),
        "equipment_report": _equipment_checks(*_EQUIPMENT_CHECKS),
        "future_overhaul_details": f"""
            SELECT equipment_id, model, {shown('last_major_overhaul')}, {shown('installation_date')},
                CAST(date_diff('day', CAST({AS_OF} AS DATE), CAST(last_major_overhaul AS DATE)) AS INT)
                    AS days_in_future
            FROM equipment WHERE last_major_overhaul > {AS_OF}""",
        "future_overhaul_summary": f"""
            SELECT strftime(MIN(last_major_overhaul), '%Y-%m-%d') AS earliest_overhaul,
                strftime(MAX(last_major_overhaul), '%Y-%m-%d') AS latest_overhaul,
                ROUND(AVG(date_diff('day', CAST({AS_OF} AS DATE), CAST(last_major_overhaul AS DATE))), 2)
                    AS avg_days_in_future
            FROM equipment WHERE last_major_overhaul > {AS_OF}""",
        "operational_date_range": _date_range("operational"),
        "invalid_production_rates": checks("operational", {k: op[k] for k in ["invalid_production_rates"]}),
        "invalid_hours": checks("operational", {k: op[k] for k in ["invalid_hours"]}),
        "invalid_product_type": checks("operational", {"invalid_product_type": op["invalid_product_types"]}),
        "invalid_material_quality": checks(
            "operational", {"invalid_raw_material_quality": op["invalid_quality_levels"]}
        ),
        "invalid_ambient": checks("operational", {k: op[k] for k in ["invalid_temperatures", "invalid_humidity"]}),
        "operator_presence": _presence("operational", "operator_id"),
        "operational_report": _operational_report("operational"),
        "hours_categories": _hours_categories("operational"),
        "hours_stats": _hours_stats("operational"),
        "hours_stats_report": _hours_stats("operational", "'before' AS phase, ")
        + " UNION ALL "
        + _hours_stats("corrected", "'after' AS phase, "),
        "corrected_hours": select(schemas.OPERATIONAL.names, "corrected"),
        "correction_report": f"""
            SELECT 'before' AS phase, * FROM ({_operational_report('operational')})
            UNION ALL SELECT 'after', * FROM ({_operational_report('corrected')})""",
        "hours_categories_report": f"""
            SELECT 'before' AS phase, * FROM ({_hours_categories('operational')})
            UNION ALL SELECT 'after', * FROM ({_hours_categories('corrected')})""",
        "maintenance_flags": _flags(),
        "maintenance_date_range": _date_range("maintenance"),
        "type_counts": _category_counts("maintenance_type", schemas.MAINTENANCE_TYPES),
        "technician_presence": _presence("maintenance", "technician_id"),
        "negative_counts": _maintenance_checks("negative_duration_hours", "negative_cost"),
        "result_counts": _category_counts("maintenance_result", schemas.MAINTENANCE_RESULTS),
        "inconsistent_replacements": _maintenance_checks("inconsistent_replacements"),
        "maintenance_report": _maintenance_checks(*_MAINTENANCE_CHECKS),
        "future_records": _flags(f'WHERE "date" > {AS_OF}'),
        "future_totals": f"""
            SELECT COUNT(*) AS total_records, {count(f'"date" > {AS_OF}')} AS future_records FROM maintenance""",
        "null_counts": _null_counts("maintenance", schemas.MAINTENANCE.names),
        "null_counts_sensor": _null_counts("sensor", schemas.SENSOR.names),
        "duplicate_counts": _duplicates("sensor"),
        "null_counts_equipment": _null_counts("equipment", schemas.EQUIPMENT.names),
        "null_counts_operational": _null_counts("operational", schemas.OPERATIONAL.names),
        "duplicate_counts_maintenance": _duplicates("maintenance"),
        "duplicate_counts_equipment": _duplicates("equipment"),
        "duplicate_counts_operational": _duplicates("operational"),
        "unique_ids": _unique_ids("sensor"),
        "unique_ids_maintenance": _unique_ids("maintenance"),
        "unique_ids_equipment": _unique_ids("equipment"),
        "unique_ids_operational": _unique_ids("operational"),
        "id_consistency": f"SELECT equipment_id FROM ({all_ids}) a WHERE {absent}",
        "id_totals": f"SELECT COUNT(*) AS total_ids, {count(absent)} AS inconsistent_ids FROM ({all_ids}) a",
    }


def _unique_ids(source: str) -> str:
    return f"SELECT COUNT(*) AS unique_ids FROM (SELECT DISTINCT equipment_id FROM {source})"


def _duplicates(source: str) -> str:
    return f"""
        SELECT total, "distinct", total - "distinct" AS duplicates
        FROM (SELECT (SELECT COUNT(*) FROM {source}) AS total,
                     (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {source})) AS "distinct")"""


def _preparation_queries() -> dict[str, str]:
    specs = [n for n in schemas.EQUIPMENT.names if n != "equipment_id"]
    logs = [n for n in schemas.MAINTENANCE.names if n not in ("equipment_id", "date")] + ["maintenance_date"]
    records = [n for n in schemas.OPERATIONAL.names if n not in ("equipment_id", "date")]
    readings = ", ".join(shown(n, "s") for n in schemas.SENSOR.names)
    age = "CAST(date_diff('day', CAST(installation_date AS DATE), CAST(\"timestamp\" AS DATE)) AS INT)"
    aged = f"(SELECT *, {age} AS equipment_age_days FROM integrated)"
    before = '"timestamp" < installation_date'
    sample_columns = ["equipment_id", "timestamp", "installation_date", "equipment_age_days"]
    derived = [n for n in schemas.FEATURED.names if n not in INTEGRATED and not n.endswith("_encoded")]
    encoded = ["equipment_id", "timestamp", *schemas.ENCODED_CATEGORIES]
    encoded += [f"{name}_encoded" for name in schemas.ENCODED_CATEGORIES]
    every = ", ".join(f'"{name}" NULLS FIRST' for name in INTEGRATED)
    per_machine = f'SELECT equipment_id, COUNT(*) AS count FROM integrated WHERE {before} GROUP BY equipment_id'
    return {
        "specs_join": f"SELECT {readings}, {', '.join(shown(n, 'e') for n in specs)} "
        "FROM sensor s LEFT JOIN equipment e ON s.equipment_id = e.equipment_id",
        "latest_maintenance": select(["equipment_id", *logs], "latest"),
        "maintenance_join": f"""
            SELECT {readings}, {', '.join(shown(n, 'm') for n in logs)},
                CAST(date_diff('day', CAST(maintenance_date AS DATE), CAST("timestamp" AS DATE)) AS INT)
                    AS days_since_maintenance
            FROM sensor s LEFT JOIN latest m ON s.equipment_id = m.equipment_id""",
        "operational_day_join": f"""
            SELECT {readings}, {', '.join(shown(n, 'o') for n in records)},
                strftime(o."date", '%Y-%m-%d %H:%M:%S') AS operation_date
            FROM sensor s LEFT JOIN operational o ON s.equipment_id = o.equipment_id
                AND CAST("timestamp" AS DATE) = CAST(o."date" AS DATE)""",
        "integrated": select(INTEGRATED, "integrated"),
        "integrated_ordered": select(INTEGRATED, "integrated"),
        "valid_readings": select(["equipment_id", "timestamp", "installation_date"], "valid"),
        "validity_counts": 'SELECT b AS "before", a AS "after", b - a AS removed FROM '
        "(SELECT (SELECT COUNT(*) FROM integrated) AS b, (SELECT COUNT(*) FROM valid) AS a)",
        "overview": f"SELECT COUNT(*) AS n_rows, {len(INTEGRATED)} AS n_columns FROM valid",
        "summary_stats": _summary(),
        "cardinality": union(
            f"SELECT '{n}' AS \"column\", COUNT(*) AS unique_values FROM (SELECT DISTINCT {n} FROM valid)" for n in TEXT
        ),
        "missing_counts": _missing_counts("valid"),
        "missing_report": _missing_counts("valid", prefix="'before' AS phase, ")
        + " UNION ALL "
        + _missing_counts("cleaned", prefix="'after' AS phase, "),
        "dropped_missing": select(INTEGRATED, "cleaned"),
        "cleaned_duplicates": _duplicates("cleaned"),
        "numeric_ranges": union(
            f"SELECT '{n}' AS \"column\", ROUND(CAST(MIN(\"{n}\") AS DOUBLE), 6) AS min, "
            f'ROUND(CAST(MAX("{n}") AS DOUBLE), 6) AS max FROM cleaned'
            for n in NUMERIC
        ),
        "frequencies": 'SELECT "column", value, n AS count, CAST(pos AS INT) AS rank FROM '
        f"({_frequency_ranks('cleaned', TEXT, null_is_value=True)}) WHERE pos <= 10",
        "outliers": _outliers(),
        "correlations": _correlations(),
        "features": select(["equipment_id", "timestamp", "days_since_maintenance", *derived], "features"),
        "label_mapping": 'SELECT "column", CAST(pos - 1 AS INT) AS code, value AS label FROM '
        f"({_frequency_ranks('cleaned', schemas.ENCODED_CATEGORIES, null_is_value=False)})",
        "label_encoded": _encoded("integrated", encoded),
        "label_encoded_featured": _encoded("features", encoded),
        "dataset_sample": select(INTEGRATED, f"(SELECT * FROM valid ORDER BY {every} LIMIT 5)"),
        "negative_age_rows": select(
            ["equipment_id", "timestamp", "equipment_age_days"], aged, "equipment_age_days < 0"
        ),
        "negative_age_sample": select(sample_columns, aged, "equipment_age_days < 0")
        + ' ORDER BY equipment_age_days, equipment_id, "timestamp" LIMIT 5',
        "negative_age_summary": f"""
            SELECT COUNT(*) AS negative_count, MIN(equipment_age_days) AS min_negative_age,
                MAX(equipment_age_days) AS max_negative_age, ROUND(AVG(equipment_age_days), 6) AS avg_negative_age
            FROM {aged} WHERE equipment_age_days < 0""",
        "invalid_timestamp_totals": f"""
            SELECT total AS total_records, bad AS invalid_records, {_share('bad', 'total')} AS percentage
            FROM (SELECT COUNT(*) AS total, {count(before)} AS bad FROM integrated)""",
        "invalid_timestamps_by_equipment": per_machine,
        "invalid_timestamp_first": per_machine + " ORDER BY equipment_id LIMIT 5",
        "invalid_timestamp_sample": select(sample_columns, aged, before)
        + ' ORDER BY equipment_id, "timestamp" LIMIT 5',
    }


def _grading_queries() -> dict[str, str]:
    key = ["equipment_id", "timestamp"]
    scores = [n for n in schemas.SCORED.names if n not in schemas.ALERTED.names]
    distribution = [
        "age_condition_score",
        "downtime_condition_score",
        "maintenance_condition_score",
        "environment_condition_score",
        "maintenance_cost_condition_score",
        "operational_score",
        "alert_score",
    ]
    total = "(SELECT COUNT(*) FROM {})"
    required = f"maintenance_needed = '{schemas.REQUIRED}'"

    def inspection(item, *signals):
        where = required if item == "Motor" else f"maintenance_item = '{item}'"
        names = ["equipment_id", "maintenance_item", *signals]
        return select([*names, "parts_replaced", "maintenance_type", "maintenance_needed"], "itemised", where)

    return {
        "alert_limits": "SELECT min_power AS min_power_output, max_power AS max_power_output, "
        "min_noise AS min_noise_level, max_noise AS max_noise_level, min_current, max_current FROM limits",
        "alerts": select([*key, *schemas.ALERT_COLUMNS, "alert"], "alerted"),
        "alert_percentages": f"SELECT alert, COUNT(*) AS count, {_decimal_share('COUNT(*)', total.format('alerted'))} "
        "AS percentage FROM alerted GROUP BY alert",
        "detailed_alert_percentages": union(
            f"SELECT '{n}' AS alert_type, {n} AS status, COUNT(*) AS count, "
            f"{_decimal_share('COUNT(*)', total.format('alerted'))} AS percentage FROM alerted GROUP BY {n}"
            for n in schemas.ALERT_COLUMNS
        ),
        "alert_sample": 'SELECT equipment_id, alert FROM alerted ORDER BY equipment_id, "timestamp", alert LIMIT 10',
        "criticality_cost": select(["criticality", "criticality_avg_annual_cost"], "costs"),
        "scores": select([*key, "alert", *scores], "scored"),
        "score_distribution": union(
            f"SELECT '{n}' AS \"column\", {n} AS value, COUNT({n}) AS count, "
            f"{_share(f'COUNT({n})', total.format('scored'))} AS percentage FROM scored GROUP BY {n}"
            for n in distribution
        ),
        "maintenance_percentages": f"SELECT maintenance_needed, COUNT(*) AS count, "
        f"{_share('COUNT(*)', total.format('scored'))} AS percentage FROM scored GROUP BY 1",
        "stat_thresholds": "SELECT item, signal, ROUND(stat, 6) AS stat FROM thresholds",
        "history_thresholds": "SELECT item, signal, ROUND(hist, 6) AS hist FROM thresholds",
        "item_thresholds": "SELECT item, signal, ROUND(stat, 6) AS stat, ROUND(hist, 6) AS hist, "
        "ROUND(LEAST(stat, hist), 6) AS threshold FROM thresholds",
        "items": select(
            [*key, "parts_replaced", "total_score", "maintenance_needed", "maintenance_item"], "itemised"
        ),
        "required_rows": select([*key, "maintenance_item"], "itemised", required),
        "item_percentages": f"SELECT maintenance_item, COUNT(*) AS count, "
        f"{_share('COUNT(*)', f'(SELECT COUNT(*) FROM scored WHERE {required})')} AS percentage "
        f"FROM itemised WHERE {required} GROUP BY 1",
        "unassigned_items": f"SELECT {count('maintenance_item IS NULL')} AS unassigned FROM itemised WHERE {required}",
        "motor_inspection": inspection(
            "Motor", "vibration", "noise_level", "temperature", "current", "power_output"
        ),
        "bearings_inspection": inspection(
            "Bearings", "vibration", "noise_level", "temperature", "rotational_speed"
        ),
        "seals_inspection": inspection("Seals", "pressure", "oil_viscosity", "temperature"),
        "filters_inspection": inspection("Filters", "pressure", "oil_viscosity", "temperature"),
        "metrics_on_rule": _report_on_rule(),
        "confusion_on_rule": "SELECT alert AS label, "
        + ", ".join(f"{count(f'temperature_alert = {chr(39)}{c}{chr(39)}')} AS \"{c}\"" for c in schemas.ALERT_LEVELS)
        + " FROM alerted GROUP BY alert",
    }


def _codes(label: str, source: str, where: str = "TRUE") -> str:
    return f"""
        SELECT CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {label}) - 1 AS INT) AS code, {label} AS label
        FROM {source} WHERE {where} AND {label} IS NOT NULL GROUP BY {label}"""


# The share of the rows that is held out, by the first 28 bits of a digest of the key.
_IS_TEST = """
    CAST('0x' || substr(md5(COALESCE(CAST(equipment_id AS VARCHAR), '') || '|'
        || COALESCE(strftime("timestamp", '%Y-%m-%d %H:%M:%S'), '') || '|42'), 1, 7) AS BIGINT) % 1000 < 200"""


def _split_sizes(label: str, source: str, where: str = "TRUE") -> str:
    return f"""
        SELECT {label} AS label, COUNT(*) FILTER (WHERE NOT ({_IS_TEST})) AS train,
            COUNT(*) FILTER (WHERE {_IS_TEST}) AS test
        FROM {source} WHERE {where} GROUP BY {label}"""


def _given_nodes() -> str:
    """Predictions of the model that is given as a node table, one join a level."""
    rows = ", ".join(str(row) for row in schemas.GIVEN_NODES)
    values = ", ".join(f'CAST("{name}" AS DOUBLE)' for name in schemas.NEED_FEATURES)
    kept = "id, x, n.round, n.klass"
    step = """
        SELECT id, x, s.round, s.klass, CASE WHEN s.feature < 0 THEN s.node
            WHEN x[greatest(s.feature, 0) + 1] <= s.split THEN s.l ELSE s.r END AS goes FROM {source} AS s"""
    join = "SELECT {kept}, n.node, n.feature, n.split, n.l, n.r, n.value FROM ({step}) m JOIN nodes n " \
        "ON m.round = n.round AND m.klass = n.klass AND m.goes = n.node"
    return f"""
        WITH nodes(round, klass, node, depth, feature, split, l, r, value) AS (VALUES {rows}),
        numbered AS (SELECT ROW_NUMBER() OVER () AS id, equipment_id, "timestamp", [{values}] AS x FROM scored),
        level0 AS (SELECT {kept}, n.node, n.feature, n.split, n.l, n.r, n.value
                   FROM numbered JOIN nodes n ON n.node = 0),
        level1 AS ({join.format(kept=kept, step=step.format(source='level0'))}),
        level2 AS ({join.format(kept=kept, step=step.format(source='level1'))}),
        margins AS (SELECT id, SUM(value) FILTER (WHERE klass = 0) AS a, SUM(value) FILTER (WHERE klass = 1) AS b
                    FROM level2 GROUP BY id),
        chances AS (SELECT id, EXP(a - GREATEST(a, b)) AS ea, EXP(b - GREATEST(a, b)) AS eb FROM margins)
        SELECT equipment_id, {shown('timestamp')}, ROUND(ea / (ea + eb), 6) AS not_required,
            ROUND(eb / (ea + eb), 6) AS required,
            CASE WHEN eb > ea THEN '{schemas.REQUIRED}' ELSE '{schemas.NOT_REQUIRED}' END AS predicted_label
        FROM chances JOIN numbered USING (id)"""


def _training_queries() -> dict[str, str]:
    key = ["equipment_id", "timestamp"]
    required = f"maintenance_needed = '{schemas.REQUIRED}'"
    flag = f"CASE WHEN {required} THEN 1 ELSE 0 END AS maintenance_encoded"
    item_names = [*key, "maintenance_item", "maintenance_needed", *schemas.ITEM_FEATURES]
    encoded = _encoded("itemised", [n for n in item_names if n != "maintenance_encoded"])
    item_rows = f"SELECT * EXCLUDE (maintenance_needed), {flag} FROM ({encoded}) WHERE {required}"
    values = union(
        f'SELECT equipment_id, "timestamp", {place} AS place, ROUND(CAST("{name}" AS DOUBLE), 6) AS value FROM picked'
        for place, name in enumerate(schemas.ITEM_FEATURES)
    )
    held_out = f"SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS differences FROM scored WHERE {_IS_TEST}"
    return {
        "alert_features": _encoded("alerted", [*key, "alert", *schemas.ALERT_FEATURES]),
        "need_features": select([*key, "maintenance_needed", *schemas.NEED_FEATURES], "scored"),
        "item_features": item_rows,
        "item_vectors": f"WITH picked AS ({item_rows}) {values}",
        "need_flags": f"SELECT {', '.join(shown(n) for n in key)}, maintenance_needed, {flag} FROM scored",
        "alert_label_codes": _codes("alert", "alerted"),
        "need_label_codes": _codes("maintenance_needed", "scored"),
        "item_label_codes": _codes("maintenance_item", "itemised", required),
        "alert_split_sizes": _split_sizes("alert", "alerted"),
        "need_split_sizes": _split_sizes("maintenance_needed", "scored"),
        "item_split_sizes": _split_sizes("maintenance_item", "itemised", required),
        "predicted_by_given_nodes": _given_nodes(),
        # What holds of any trained model: counts of its splits, and equal predictions two ways.
        "importance_checks_need": "SELECT TRUE AS counts_all_splits, TRUE AS only_job_features",
        "saved_need": held_out,
        "walked_need": held_out,
    }


def oracle_sql() -> dict[str, str]:
    ctes = ", ".join(f"{name} AS ({body})" for name, body in _ctes().items())
    bodies = {**_check_queries(), **_preparation_queries(), **_grading_queries(), **_training_queries()}
    return {name: f"WITH {ctes} SELECT * FROM ({body})" for name, body in bodies.items()}
