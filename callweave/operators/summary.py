"""The summary of a capture as rows of eight sections, explained failures, and scenarios by family and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators.rollups import dimension

#: In the order of the document.
SECTIONS = ("capture", "not_visible", "network_elements", "subscribers", "procedures", "failures", "cause_rollup", "blast_radius")


def failure_records(failures: DataFrame, guide: DataFrame) -> DataFrame:
    """failures with what the cause table says of them: specification, clause, explanation, common causes, and whether it is known.

    guide: table, value, name, spec, clause, plain, common_causes (as `readers.load_causes`
    gives them). A failure without a cause keeps nulls and is not known.
    """
    dim = dimension(guide.select(F.col("table").alias("cause_table"), F.col("value").alias("cause_value"), "spec", "clause", F.col("plain").alias("explanation"), "common_causes", F.lit(True).alias("known")))
    return failures.join(dim, ["cause_table", "cause_value"], "left").fillna(False, ["known"])


def scenario_details(procedures: DataFrame) -> DataFrame:
    """Per family, kind, direction and trigger (null where it has none): outcomes, most frequent cause, a sample frame (a failure's first).

    Causes of equal counts: the first in order of their text. Places as in
    `rollups.scenario_breakdown`; the window holds a row per scenario.
    """
    by = ["capture_id", "family", "kind", "direction", "trigger"]
    # Counted per cause first, so that a scenario's second step sees a row per cause, not per procedure.
    causes = procedures.groupBy(*by, "cause").agg(
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "incomplete", "cancelled")), F.count("*").alias("total"),
        F.min(F.struct(F.when(F.col("outcome") == "failure", 0).otherwise(1).alias("r"), F.col("start_frame").alias("f"))).alias("sample"),
    )
    rows = causes.groupBy(*by).agg(
        *(F.sum(o).alias(o) for o in ("success", "failure", "incomplete", "cancelled", "total")), F.min("sample")["f"].alias("sample_frame"),
        F.min(F.when(F.col("cause").isNotNull(), F.struct((-F.col("total")).alias("n"), F.col("cause").alias("c"))))["c"].alias("top_cause"),
    )
    order = [F.desc("failure"), F.desc("incomplete"), F.desc("total"), *(F.col(c).asc_nulls_first() for c in by[1:])]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("capture_id").orderBy(*order)))


def _micros(seconds: str) -> Column:
    return F.round(F.col(seconds) * 1_000_000).cast("long")


def _section(name: str, rows: DataFrame, frame: Column, key: Column, record: list) -> DataFrame:
    return rows.select("capture_id", F.lit(name).alias("section"), frame.cast("long").alias("at_frame"), key.alias("at_key"), F.to_json(F.struct(*record), {"ignoreNullFields": "false"}).alias("record"))


def summary_sections(facts: DataFrame, hidden: DataFrame, elements: DataFrame, subscribers: DataFrame, procedures: DataFrame, failures: DataFrame, causes: DataFrame, blast: DataFrame) -> DataFrame:
    """capture_id, section, at_frame, at_key, record: one JSON record per row.

    A document of one row would hold every procedure and failure of a capture; as rows
    it has no bound and no group. The inputs are the roll-ups of those names; a section
    is in order by (at_frame, at_key). Times are microseconds. Subscribers and elements without
    a name come first; an empty input leaves out its section.
    """
    none, text = F.lit(None), lambda *c: F.concat_ws("/", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c))
    parts = [
        _section("capture", facts, none, F.lit(""), ["frames", _micros("span").alias("span_us"), "protocols"]),
        _section("not_visible", hidden, none, text("kind"), ["kind", "n"]),
        _section("network_elements", elements, none, text("address"), ["address", "messages", "ports"]),
        _section("subscribers", subscribers.where("kind = 'supi'"), none, text("value"), [F.col("value").alias("supi"), "messages", "flows", "failures"]),
        _section("procedures", procedures, F.col("start_frame"), text("flow_id", "segment"), ["flow_id", "segment", "kind", "outcome", "cause", "first_failure", "start_frame", "end_frame", _micros("duration").alias("duration_us"), "messages", "trigger", "direction", "dnn", "supi"]),
        _section("failures", failures, F.col("frame"), text("protocol", "label"), ["frame", "protocol", "label", "cause_table", "cause_value", "cause_name", "known", "explanation", "common_causes"]),
        _section("cause_rollup", causes, F.col("first_frame"), text("cause_name"), ["cause_name", "n", "first_frame", "subscribers"]),
        _section("blast_radius", blast, none, text("dimension", "value"), ["dimension", "value", "failures", "subscribers"]),
    ]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def write_summary(sections: DataFrame, path: str) -> None:
    """JSON lines by capture and section, ordered; a large capture is cut over files by range, not gathered in one."""
    number = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    order = ["capture_id", number, F.col("at_frame").asc_nulls_first(), "at_key"]
    sections.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("capture_id", "section").json(path)
