"""Secret scans over a ledger of blobs: every text version is addressed by its content, a blob is scanned once per rule
version, and findings are joined back to every path that has the blob. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import digest, fresh, keep, keyed_join, scratch, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: code points that capture group `group` must have, else the match is dropped; hint: a
    cheaper pattern or a literal that every text with a match has."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed by the contract: assign, access and hex, in this order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", least=24),  # the same runs as [0-9a-f]+ with 24 or more characters
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hint="eyJ"),
)
RULES = BASE + EXTRA


def may_match(rule: Rule, text: Column) -> Column:
    found = text.rlike(rule.pattern)
    return text.contains(rule.hint) & found if rule.hint else found


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, kind_no, kind, start, end) of (blob, text, todo): leftmost non-overlapping matches of each rule in todo, in
    code points. Where matches stand follows from the lengths of the texts between them, which the same pattern splits."""
    any_ = reduce(lambda a, b: a | b, [F.array_contains("todo", r.name) & may_match(r, F.col("text")) for r in rules])
    hit = keep(blobs.where(any_), "hits", wide=True)

    def of(number: int, rule: Rule) -> DataFrame:
        p = F.lit(rule.pattern)
        found = hit.where(F.array_contains("todo", rule.name) & may_match(rule, F.col("text")))
        lengths = lambda c: F.transform(c, F.length)
        zipped = F.arrays_zip(lengths(F.split("text", rule.pattern, -1)).alias("gap"), lengths(F.regexp_extract_all("text", p, F.lit(0))).alias("len"), lengths(F.regexp_extract_all("text", p, F.lit(rule.group))).alias("value"))
        rows = found.select("blob", F.posexplode(zipped).alias("i", "z")).select("blob", "i", "z.gap", "z.len", "z.value").where("len is not null")
        through = Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("gap") + F.col("len")).over(through)
        rows = rows.withColumn("end", end).where(F.col("value") >= rule.least)
        return rows.select("blob", F.lit(rule.name).alias("rule"), F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), (F.col("end") - F.col("len")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))

    return reduce(DataFrame.unionByName, [of(i, r) for i, r in enumerate(rules)])


class Ledger:
    """Two tables at a path: scanned (blob, rules) and findings (blob, rule, kind_no, kind, start, end). A scan writes a part of
    each, findings first, so a scan that broke off is repeated and its rows count once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.scanned_schema, self.finding_schema = "blob string, rules array<string>", "blob string, rule string, kind_no int, kind string, start long, end long"

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.scanned_schema)

    def findings(self) -> DataFrame:
        return self._read("findings", self.finding_schema).distinct()

    def scan(self, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scans the blobs of (blob, text) for the rule versions that the ledger doesn't have of them."""
        names = F.array(*[F.lit(r.name) for r in rules])
        seen = self.scanned()
        if seen.isEmpty():
            fresh = texts.withColumn("todo", names)
        else:
            had = seen.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("had"))
            fresh = texts.join(had, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("had", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("had")
        # one copy of each blob: copies within a task are dropped before the shuffle
        blobs = fresh.groupBy("blob", "todo").agg(F.first("text").alias("text"))
        known = fresh.select("blob", F.col("todo").alias("rules")).distinct()
        find_spans(blobs, rules).write.mode("append").parquet(f"{self.path}/findings")
        known = keep(known, "scanned")
        known.write.mode("append").parquet(f"{self.path}/scanned")


def spans_of(ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans): spans of these versions of the rules as structs (start, kind_no, end, kind), in order of start, then
    of the rules."""
    of = ledger.findings().where(F.col("rule").isin(*[r.name for r in rules]))
    return keep(of.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind"))).alias("spans")), "spans")


def at_paths(paths: DataFrame, found: DataFrame, spans: str) -> DataFrame:
    """Rows of paths with the findings of their blob, null where there are none. Copies of one blob spread over tasks."""
    blob = found.columns[0]
    return keyed_join(paths, found, [blob], "left", weight=F.greatest(F.size(spans), F.lit(1)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in `text` replaced by `mark`; overlapping spans give one mark. Every other column, of any name,
    stays as it is; a null text stays null; repeated rows stay."""
    blob, spans = fresh("_blob", docs), fresh("_spans", docs)
    found = spans_of(ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    texts = at_paths(docs.withColumn(blob, digest(docs["text"])), found, spans)

    def cut(acc: Column, s: Column) -> Column:
        new = s["start"] + 1 >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"].cast("int"), F.greatest(s["start"] + 1 - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), F.concat(acc["out"], gap, F.when(new, mark).otherwise("")).alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int"), F.length("text")))

    clean = F.aggregate(F.col(spans), F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out")), cut, rest)
    return texts.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(clean)).select(*[F.col(f"`{c}`") for c in docs.columns])


def scan_texts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> Ledger:
    """The ledger at `path` (a new one by default) after a scan of docs' texts."""
    ledger = Ledger(docs.sparkSession, path or scratch(docs.sparkSession, "ledger"))
    ledger.scan(docs.select(digest(docs["text"]).alias("blob"), docs["text"].alias("text")).where("text is not null"), rules)
    return ledger


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document by kind, with a digest of the base spans and all spans.

    A null or empty text has none; null doc_ids stay; repeated rows and copies get the findings of their common blob,
    scanned once; an empty table gives no rows. Extra columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    found = spans_of(scan_texts(docs), RULES)
    base = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    paths = keep(docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest(docs["text"]).alias("blob")), "paths", wide=True)
    per = at_paths(paths, found, "spans")
    per = per.select("doc_id", *[count(k) for k in base], F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), F.when(F.col("spans").isNotNull(), joined(F.col("spans"))).alias("spans"))
    per = per.withColumns({f"n_{k}": F.when(F.col("spans").isNotNull(), F.col(f"n_{k}")) for k in base})
    none = {"n_assign": F.lit(0).cast("long"), "n_access": F.lit(0).cast("long"), "n_hex": F.lit(0).cast("long"), "base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return per.select("doc_id", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def _sql() -> str:
    """The same spans in SQL: positions by the lengths of what the pattern splits."""
    rules = {"assign": (0, BASE[0].pattern, 2, 6), "access": (1, r"AKIA[A-Z0-9]+", 0, 20), "hex": (2, r"[0-9a-f]{24,}", 0, 24)}
    parts = []
    for kind, (no, pattern, group, least) in rules.items():
        q = pattern.replace("'", "''")
        parts.append(f"""
SELECT r, {no} AS k, '{kind}' AS kind, e - len AS s, e FROM (
  SELECT r, value, len, sum(gap + len) OVER (PARTITION BY r ORDER BY i) AS e FROM (
    SELECT r, unnest(range(len(m))) AS i, unnest(m) AS m1, unnest(v) AS v1, unnest(g[1:len(m)]) AS g1, length(m1) AS len, length(v1) AS value, length(g1) AS gap FROM (
      SELECT r, regexp_extract_all(t, '{q}') AS m, regexp_extract_all(t, '{q}', {group}) AS v, string_split_regex(t, '{q}') AS g FROM d)
    )) WHERE value >= {least}""")
    spans = "\nUNION ALL".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({spans}),
a AS (SELECT r, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS j FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(j, '')) AS base_sha256, coalesce(j, '') AS spans FROM d LEFT JOIN a USING (r)
"""


OP6_SQL = _sql()
