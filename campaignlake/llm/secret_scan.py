"""Secret scan with multipart credential linking, built-in functions only.

Base spans are the matches of three patterns (assignment of a named secret, access identifier, long hex run).
Linking adds weak candidates: a 40-character mixed token or a URL says nothing on its own, but near an access
identifier it is the other part of a credential. Candidates and access identifiers meet in an interval join:
both are put into character blocks of one scope length, blocks meet on equality, and a semi join keeps
candidates with an access identifier within the scope (endpoints also need a secret within it). A block holds
a bounded number of parts, so no group grows with the data.

Defined cases: null text is empty and has no spans; repeated rows each give a row; doc_id may be null; a table
without rows gives none; other input columns are not read. Positions are code points, end exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlake.llm.common import staged, text_column

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = {"assign": 0, "access": 1, "hex": 2, "weak_secret": 3, "endpoint": 4}

WEAK_SECRET = r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+=]{0,39}[0-9])(?=[A-Za-z0-9/+=]{0,39}[A-Z])(?=[A-Za-z0-9/+=]{0,39}[a-z])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9._~/%-]*)?"
MIN_VALUE = 6
SCOPE = 400


def _raw(text: Column, kind: str, pattern: str, when: Column, value_group: int = 0) -> Column:
    """Per match of `pattern`: its kind, characters since the previous match, its own length, and its value's."""
    p = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"),
        F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, p, F.lit(value_group)).alias("value"),
    )
    one = lambda i, x: F.struct(
        F.lit(KINDS[kind]).alias("kind"),
        i.alias("i"),
        F.length(x["gap"]).alias("gap"),
        F.length(x["hit"]).alias("len"),
        F.length(x["value"]).alias("value"),
    )
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,value:int>>")
    return F.when(when, F.transform(parts, lambda x, i: one(i, x))).otherwise(empty)


NAMED = r"(?i:passw(or)?d|secret|token|api_?key)"


def _parts(docs: DataFrame, *keys: Column) -> DataFrame:
    """(doc_id, keys, _row, raw): one row per document, staged, so that texts are scanned once and `_row` is fixed."""
    t = F.col("_text")
    access = t.contains("AKIA")
    raw = F.concat(
        _raw(t, "assign", ASSIGN, t.rlike(NAMED), 2),
        _raw(t, "access", ACCESS, access),
        _raw(t, "hex", HEX, t.rlike(HEX)),
        _raw(t, "weak_secret", WEAK_SECRET, access),
        _raw(t, "endpoint", ENDPOINT, access),
    )
    texts = docs.select(F.col("doc_id"), *keys, text_column(docs).alias("_text"))
    rows = texts.drop("_text").columns
    return staged(texts.select(*rows, F.monotonically_increasing_id().alias("_row"), raw.alias("raw")), "secret-parts")


def _placed(parts: DataFrame) -> DataFrame:
    """(_row, kind, start, end, value): positions from running sums over a document's matches of one kind."""
    upto = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return (
        parts.select("_row", F.inline("raw"))
        .withColumn("end", end)
        .select("_row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value")
        .where((F.col("kind") != KINDS["assign"]) | (F.col("value") >= MIN_VALUE))
    )


def _near(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates with one of `parts` of the same document within SCOPE characters."""
    cells = F.explode(
        F.sequence(F.expr(f"(start - {SCOPE}) div {SCOPE} - 1"), F.expr(f"(end + {SCOPE}) div {SCOPE}"))
    )
    p = parts.select(F.col("_row").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"), cells.alias("_cell")).distinct()
    c = candidates.withColumn("_in", F.expr(f"start div {SCOPE}"))
    meets = (
        (c["_row"] == p["_r"])
        & (c["_in"] == p["_cell"])
        & (c["start"] <= p["_e"] + SCOPE)
        & (c["end"] >= p["_s"] - SCOPE)
        & ((c["end"] <= p["_s"]) | (c["start"] >= p["_e"]))
    )
    return c.join(p, meets, "left_semi").drop("_in")


def secret_spans(docs: DataFrame, *keys: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): doc_id and keys with a row number `_row` for every document, and (_row, kind, start, end)."""
    parts = _parts(docs, *keys)
    placed = _placed(parts)
    of = lambda *kinds: placed.where(F.col("kind").isin([KINDS[k] for k in kinds]))
    base = of("assign", "access", "hex")
    access = of("access")
    weak = _near(of("weak_secret"), access)
    secrets = reduce(DataFrame.unionByName, [of("assign", "hex"), weak])
    endpoints = _near(_near(of("endpoint"), access), secrets)
    spans = reduce(DataFrame.unionByName, [base, weak, endpoints]).select("_row", "kind", "start", "end")
    return parts.drop("raw"), spans


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(
        spans,
        lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, a hash of the base spans, and all spans in text order."""
    rows, spans = secret_spans(docs)
    found = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("_all"))
    every = F.coalesce(F.col("_all"), F.array().cast("array<struct<start:long,kind:int,end:long>>"))
    base = F.filter(every, lambda s: s["kind"] <= KINDS["hex"])
    number = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == KINDS[kind])).cast("long")
    return rows.join(found, "_row", "left").select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """`docs` with every span in its text replaced by `mark` and n_chars counted anew; columns as they were.

    Only rows that hold a base pattern's beginnings are joined with spans, by a hash of their text; the others pass.
    """
    columns = docs.columns
    suspect = F.coalesce(docs["text"].rlike(f"{NAMED}|AKIA|{HEX}"), F.lit(False))
    key = F.sha2(F.encode(docs["text"], "UTF-8"), 256).alias("_key")
    hot = docs.where(suspect)
    rows, spans = secret_spans(hot.dropDuplicates(["text"]), key)
    places = F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans")
    by_text = rows.join(spans, "_row").groupBy("_key").agg(places)
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def put(acc, s):
        fresh = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.when(
            s["start"] >= acc["at"], F.struct(F.concat(acc["out"], fresh, F.lit(mark)).alias("out"), s["end"].alias("at"))
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    none = F.array().cast("array<struct<start:long,end:long>>")
    cleaned = hot.withColumn("_key", key).join(by_text, "_key", "left").withColumn(
        "text", F.aggregate(F.coalesce("_spans", none), start, put, rest)
    )
    if "n_chars" in columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~suspect).unionByName(cleaned.select(*columns))
