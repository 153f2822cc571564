"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is a row; its content's SHA-256 names a blob. The ledger holds one row
per blob and rule that has been scanned, with the spans found. A scan takes only the pairs of blob
and rule version that the ledger lacks, appends them, and joins findings back to all paths.
DataFrame functions only. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm.shared import fresh_path

SALTS = 16


@dataclass(frozen=True)
class Rule:
    """A pattern; a match stands if the given group (0: all) has at_least code points. A new version is scanned anew."""

    kind: str
    version: int
    pattern: str
    group: int
    at_least: int


# The three kinds of secrets, in the order that breaks ties between spans.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
)

SPAN = "struct<start:int,order:int,kind:string,end:int>"
LEDGER = f"blob string, kind string, version int, spans array<{SPAN}>"


def bounded_pattern(rule: Rule) -> str:
    """A run of one character class cannot hold a longer run, so its least length can go into the pattern."""
    if rule.group or not rule.pattern.endswith("]+"):
        return rule.pattern
    return f"{rule.pattern[:-1]}{{{rule.at_least - len('AKIA') * rule.pattern.startswith('AKIA')},}}"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's leftmost non-overlapping matches that stand, as an array of spans; empty for none."""
    bounded = bounded_pattern(rule)
    found = F.regexp_extract_all(text, F.lit(bounded), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(bounded), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, bounded, -1)
    walk = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["all"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end")))).alias("all"),
        ),
    )["all"]
    standing = F.filter(F.arrays_zip(walk.alias("p"), value.alias("v")), lambda x: F.length(x["v"]) >= rule.at_least)
    spans = F.transform(standing, lambda x: F.struct(x["p"]["start"].alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), x["p"]["end"].alias("end")))
    return F.when(text.rlike(bounded), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; empty where none has been written."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as e:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_unseen(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the pairs of blob and rule version that the ledger lacks, appends them, and returns the ledger.

    versions: one row per version of a path, with a text column (null: empty). Equal texts are one blob,
    scanned once; the rules still due are found per blob, so a new rule scans old blobs with itself only.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    known = read_ledger(spark, ledger_path).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    due = blobs.join(known, "blob", "left")
    pairs = F.array(
        *(
            F.when(
                F.col("done").isNull() | ~F.array_contains("done", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
                F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r, i).alias("spans")),
            )
            for i, r in enumerate(rules)
        )
    )
    new = due.select("blob", F.explode(F.array_compact(pairs)).alias("p")).select("blob", "p.*")
    new.write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions with its blob and ``found``: its spans by start, then by the rules' order.

    Rows without a finding, a null text among them, have an empty array. Blobs with findings are salted,
    since one blob may lie under a third of all paths. Columns blob and found are replaced.
    """
    versions = versions.drop("blob", "found")
    current = F.struct("kind", "version").isin(*(F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules))
    hits = ledger.where((F.size("spans") > 0) & current).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("found"))
    hits = hits.select("blob", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__sw_salt"))
    text = F.coalesce(F.col("text"), F.lit(""))
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in versions.columns if c != "text")), F.lit(SALTS)).cast("int")
    paths = versions.withColumns({"blob": F.sha2(text, 256), "__sw_salt": salt})
    joined = paths.join(hits, ["blob", "__sw_salt"], "left")
    return joined.select(*versions.columns, "blob", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def op3_secret_scan(spark: SparkSession, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = scan_unseen(docs, ledger_path or fresh_path(spark, "ledger"))
    found = findings(docs, ledger).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(r.kind) for r in RULES), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _op3_rows(rule: Rule, order: int) -> str:
    pattern = bounded_pattern(rule).replace("'", "''")
    found = lambda group: f"regexp_extract_all(t, '{pattern}', {group})"
    return f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, {rule.at_least} AS least, {found(0)} AS a, {found(rule.group)} AS v, regexp_split_to_array(t, '{pattern}') AS gaps FROM d"


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_op3_rows(r, i) for i, r in enumerate(RULES))}),
each AS (SELECT doc_id, kind, ord, least, unnest(gaps[1 : len(a)]) AS gap, unnest(a) AS m, unnest(v) AS value, generate_subscripts(a, 1) AS i FROM found),
placed AS (SELECT doc_id, kind, ord, length(m) AS size, length(value) >= least AS stands,
  sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each),
spans AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - size, ord) AS spans
  FROM placed WHERE stands GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans USING (doc_id)
"""
