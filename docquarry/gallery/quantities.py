"""Quantities, terms and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.fixed_values import CANONICAL_FIELD, UNITS
from docquarry.functions import quantities as q
from docquarry.functions import scalars as sc
from docquarry.functions import terms as tm
from docquarry.gallery.registry import EVENT_ID, TEXT_ID, query
from docquarry.operators.normalise import normalise_quantities, normalise_terms, prefix_report
from docquarry.sources import tables as t


def shift_sql(value: str, exponent: str) -> str:
    """The decimal shift in SQL, for the comparison."""
    text = f"upper(CAST({value} AS VARCHAR))"
    return (
        f"CAST(split_part({text},'E',1)||'E'||"
        f"(coalesce(TRY_CAST(nullif(split_part({text},'E',2),'') AS INTEGER),0)+({exponent})) AS DOUBLE)"
    )


def _units(dimension: str) -> list[tuple]:
    return [u for u in UNITS if u[0] == dimension]


def _unit_of(dimension: str):
    """The unit of an event: picked by its user, one id in five has a unit nobody knows."""
    units = _units(dimension)
    choice = F.lit("cubit")
    for i, u in enumerate(units):
        choice = F.when(F.col("user_id") % (len(units) + 1) == i, u[1]).otherwise(choice)
    return choice


def _unit_sql(dimension: str) -> str:
    units = _units(dimension)
    cases = " ".join(f"WHEN {i} THEN '{u[1]}'" for i, u in enumerate(units))
    return f"CASE user_id % {len(units) + 1} {cases} ELSE 'cubit' END"


def _dimension_sql(dimension: str) -> str:
    rows = ", ".join(f"('{u[1]}', {u[2]}, {u[3]}, {str(u[4]).lower()})" for u in _units(dimension))
    scaled = f"{shift_sql('value', 'e')} * m"
    return f"""
        SELECT id, unit AS source_unit, value AS source_value, CASE WHEN e = 0 THEN value * m ELSE {scaled} END AS canonical, a AS approximate
        FROM (SELECT {EVENT_ID} AS id, value, {_unit_sql(dimension)} AS unit FROM events) ev
        LEFT JOIN (VALUES {rows}) u(name, e, m, a) ON u.name = ev.unit"""


for _dimension in CANONICAL_FIELD:

    def _quantity(spark, folder, dimension=_dimension):
        rows = t.table(spark, folder, "events").select(
            t.uid("event:", F.col("event_id")).alias("id"), "value", _unit_of(dimension).alias("unit")
        )
        out = normalise_quantities(rows, {"amount": ("value", "unit", dimension)})
        return out.select(
            "id",
            F.col("amount.source_unit").alias("source_unit"),
            F.col("amount.source_value").alias("source_value"),
            F.col(f"amount.{CANONICAL_FIELD[dimension]}").alias("canonical"),
            F.col("amount.approximate").alias("approximate"),
        )

    query(f"quantity_{_dimension}", _dimension_sql(_dimension))(_quantity)


@query(
    "unknown_units",
    f"""SELECT dims AS unknown_units, count(*) AS n_documents FROM (
          SELECT CASE WHEN {_unit_sql('mass')} = 'cubit' THEN 'm,' ELSE '' END ||
                 CASE WHEN {_unit_sql('length')} = 'cubit' THEN 'l,' ELSE '' END AS dims FROM events) GROUP BY dims""",
)
def unknown_units(spark, folder):
    rows = t.table(spark, folder, "events").select(
        "value", _unit_of("mass").alias("mass_unit"), _unit_of("length").alias("length_unit")
    )
    out = normalise_quantities(
        rows,
        {"m": ("value", "mass_unit", "mass"), "l": ("value", "length_unit", "length")},
        units=q.units_table(spark),
    )
    names = F.array_join(F.transform("unknown_units", lambda u: F.concat(u, F.lit(","))), "")
    return out.groupBy(names.alias("unknown_units")).agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "quantity_concentration",
    f"""SELECT {EVENT_ID} AS id, CASE WHEN event_type = 'view' THEN value END AS molar,
               CASE WHEN event_type = 'view' THEN 'Molar' ELSE 'drops' END AS source_unit FROM events""",
)
def quantity_concentration(spark, folder):
    unit = F.when(F.col("event_type") == "view", "Molar").otherwise("drops")
    amount = q.concentration(F.col("value"), unit)
    return t.table(spark, folder, "events").select(
        t.uid("event:", F.col("event_id")).alias("id"),
        amount["molar"].alias("molar"),
        amount["source_unit"].alias("source_unit"),
    )


@query(
    "convert",
    f"""SELECT {EVENT_ID} AS id,
               value * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 60 ELSE 3600 END / 86400 AS days,
               {shift_sql(f"CASE event_type WHEN 'error' THEN {shift_sql('value', '-3')} ELSE {shift_sql('value', '-6')} END", '9')} AS nanovolts
        FROM events""",
)
def convert(spark, folder):
    return t.events(spark, folder).select(
        "id",
        q.convert(F.col("event.elapsed"), "duration", F.lit("day")).alias("days"),
        q.convert(F.col("event.gain"), "voltage", F.lit("nanovolt")).alias("nanovolts"),
    )


@query(
    "normalise_terms",
    f"""SELECT {TEXT_ID} AS id, CASE lang WHEN 'en' THEN 'uberon:' WHEN 'de' THEN 'uberon:' WHEN 'fr' THEN 'placeholder:' ELSE 'unheard:' END || source AS node,
          source AS name,
          CASE WHEN lang IN ('en', 'de') THEN 'http://purl.obolibrary.org/obo/UBERON_'||source END AS uri,
          CASE WHEN lang IN ('en', 'de') THEN 'known' WHEN lang = 'fr' THEN 'approximate' ELSE 'unknown' END AS prefix_status
        FROM documents""",
)
def normalise_terms_query(spark, folder):
    rows = t.text_docs(spark, folder).select(
        "id", F.col("text_doc.subject.node").alias("raw_node"), F.col("text_doc.source").alias("label")
    )
    out = normalise_terms(rows, "raw_node", "label", tm.prefix_table(spark))
    return out.select("id", F.col("term.node").alias("node"), F.col("term.name").alias("name"), "uri", "prefix_status")


@query(
    "prefix_report",
    """SELECT CASE WHEN lang IN ('en', 'de') THEN 'uberon' WHEN lang = 'fr' THEN 'placeholder' ELSE 'unheard' END AS prefix,
              count(*) AS n_values,
              CASE WHEN lang IN ('en', 'de') THEN 'known' WHEN lang = 'fr' THEN 'approximate' ELSE 'unknown' END AS prefix_status
       FROM documents GROUP BY 1, 3""",
)
def prefix_report_query(spark, folder):
    nodes = t.text_docs(spark, folder).select(F.col("text_doc.subject.node").alias("node"))
    return prefix_report(nodes, ["node"], tm.prefix_table(spark))


@query(
    "term_expressions",
    """SELECT c_custkey AS key, 'nation:'||c_nationkey AS curie, lower(c_mktsegment) AS prefix,
              c_name||':x' AS local_part, lower(replace(c_mktsegment||' CCF v3', ' ', '_')) AS normal_prefix,
              CASE WHEN c_nationkey % 2 = 0 THEN 'ontology_label' ELSE c_mktsegment END AS class_name,
              CASE WHEN c_nationkey % 2 = 0 THEN 'data_type' ELSE c_mktsegment END AS field_name
       FROM customer""",
)
def term_expressions(spark, folder):
    even = F.col("c_nationkey") % 2 == 0
    curie = F.concat("c_mktsegment", F.lit(":"), "c_name", F.lit(":x"))
    return t.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"),
        tm.curie_from_parts(F.lit("NATION"), F.col("c_nationkey")).alias("curie"),
        tm.curie_prefix(curie).alias("prefix"),
        tm.curie_local(curie).alias("local_part"),
        tm.normalise_prefix(F.concat("c_mktsegment", F.lit(" CCF v3"))).alias("normal_prefix"),
        tm.snake_class(F.when(even, "ontologyLabel").otherwise(F.col("c_mktsegment"))).alias("class_name"),
        tm.snake_field(F.when(even, "dataType").otherwise(F.col("c_mktsegment"))).alias("field_name"),
    )


@query(
    "semver",
    """SELECT p_partkey AS key, CAST(p_size AS INTEGER) AS major, CAST(p_partkey % 7 AS INTEGER) AS minor,
              p_size = 3 AS same_major,
              p_size > 10 OR (p_size = 10 AND (p_partkey % 7 > 2 OR (p_partkey % 7 = 2 AND 1 > 0))) AS newer
       FROM part""",
)
def semver(spark, folder):
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), F.lit("1"))
    parsed = sc.semver(version)
    return t.table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"),
        parsed["major"].alias("major"),
        parsed["minor"].alias("minor"),
        sc.same_major(version, F.lit("3.9.9")).alias("same_major"),
        (parsed > sc.semver(F.lit("10.2.0"))).alias("newer"),
    )


@query(
    "parse_datestamp",
    f"""SELECT {EVENT_ID} AS id, event_type = 'error' AS is_null,
               CASE WHEN event_type <> 'error' THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds FROM events""",
)
def parse_datestamp(spark, folder):
    raw = F.when(F.col("event.event_type") == "error", F.concat(F.lit("x"), "datestamp_raw")).otherwise(F.col("datestamp_raw"))
    parsed = sc.parse_datestamp(raw)
    return t.events(spark, folder).select(
        "id", parsed.isNull().alias("is_null"), F.unix_seconds(parsed).alias("seconds")
    )


@query(
    "unwrap_singleton",
    f"""SELECT {TEXT_ID} AS id, CASE WHEN NOT contains(text, chr(10)) THEN text END AS only_line,
               contains(text, chr(10)) AS is_error FROM documents""",
)
def unwrap_singleton(spark, folder):
    lines = F.split(F.col("text_doc.text"), "\n")
    return t.text_docs(spark, folder).select(
        "id", sc.unwrap_singleton(lines).alias("only_line"), sc.singleton_error(lines).alias("is_error")
    )


@query(
    "bandwidth_octaves",
    f"""SELECT {EVENT_ID} AS id,
          CASE WHEN user_id % 5 = 0 THEN CAST('inf' AS DOUBLE) WHEN user_id % 5 = 1 THEN CAST('-inf' AS DOUBLE)
               ELSE round(ln(value / 2) / ln(2), 9) END AS octaves FROM events""",
)
def bandwidth_octaves(spark, folder):
    low = F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(2.0)
    high = F.when(F.col("user_id") % 5 == 1, 0.0).otherwise(F.col("value"))
    return t.table(spark, folder, "events").select(
        t.uid("event:", F.col("event_id")).alias("id"), F.round(sc.bandwidth_octaves(low, high), 9).alias("octaves")
    )
