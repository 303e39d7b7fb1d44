"""Secret scans: pattern matches with code-point spans, and corpus-wide ownership frequency.

A value that many owners or repositories share is a copied example; one that a
single owner holds looks live. Everything is DataFrame expressions. Texts are
scanned once; what follows works on the few matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import joinable, let, materialise, unused

#: Base kinds in order: name -> (pattern, group that is the value, least length of it).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
#: Kinds that are reported only where their value looks live, and redacted anywhere: issued tokens, signed tokens, key blocks, credentials in addresses.
ADDED = {
    "issued": (r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 14),
    "signed": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    "block": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x20\n\r]+", 0, 40),
    "address": (r"[a-z]{3,12}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{4,}@", 0, 12),
}
KINDS = {**BASE, **ADDED}
ORDER = {name: k for k, name in enumerate(KINDS)}
#: Rows whose text may hold a match of an added kind.
_MARKS = r"gh[pousr]_|xox[abprs]-|sk_(?:live|test)_|AIza|eyJ|PRIVATE KEY|://[^\x20\x09-\x0D/:@]{1,64}:"
SPAN = "array<struct<start:int,kind:int,end:int,value:bigint>>"


def _matches(text: Column, name: str) -> Column:
    """Leftmost non-overlapping matches of one kind as SPAN, failing ones dropped.

    split() gives what lies between matches and regexp_extract_all() the
    matches, so running lengths of both are the places.
    """
    pattern, group, least = KINDS[name]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.transform(found, lambda x: F.length(x)).alias("run"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(ORDER[name]).alias("kind"), (begin + x["run"]).alias("end"), F.xxhash64(x["value"]).alias("value"))
        return F.struct(
            (begin + F.coalesce(x["run"], F.lit(0))).alias("at"),
            F.when(F.coalesce(F.length(x["value"]) >= least, F.lit(False)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def hits(text: Column) -> Column:
    """All matches of a text as SPAN, by start, then kind as listed. Kinds that a text lacks cost one search."""
    none = F.array().cast(SPAN)
    text = F.coalesce(text, F.lit(""))
    base = [F.when(text.rlike(KINDS[name][0]), _matches(text, name)).otherwise(none) for name in BASE]
    added = F.when(text.rlike(_MARKS), F.concat(*[F.when(text.rlike(KINDS[name][0]), _matches(text, name)).otherwise(none) for name in ADDED])).otherwise(none)
    return F.sort_array(F.concat(*base, added))


def ownership(found: DataFrame, max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """value, n_owners, n_repos, live of each matched value.

    found: value, owner, repo. Distinct (value, owner, repo) first, so that a
    value copied a million times within a repository is one row before it is
    counted; live: at most max_owners owners and max_repos repositories.
    """
    by_owner = found.groupBy("value", "owner", "repo").agg(F.lit(1).alias("__one")).groupBy("value", "owner").agg(F.count("__one").alias("__repos"))
    out = by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("__repos").alias("n_repos"))
    return out.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def scan(docs: DataFrame, max_owners: int = 1, max_repos: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per document: doc_id, text_key, hits (all matches), n_live.

    hits: array of (start, kind number, end, value hash, live), by start, then
    kind. Spans are code points with exclusive ends. A null or empty text has
    no hits; a null owner counts as an owner of its own, and so does a null id
    as a repository. Repeated rows keep a row each. text_key is a hash of the
    text, so that (doc_id, text_key) leads back to the text.
    """
    text = F.col(text_col)
    scanned = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), hits(text).alias("hits")),
        "secret-hits",
    )
    with_any = scanned.where(F.size("hits") > 0)
    # equal rows have equal hits: one row of each with the number of rows it stands for
    rows = with_any.groupBy("doc_id", "owner", "text_key").agg(F.first("hits").alias("hits"), F.count(F.lit(1)).alias("__n"))
    each = rows.select("doc_id", "owner", "text_key", "__n", F.explode("hits").alias("__h"))
    known = ownership(each.select(F.col("__h.value").alias("value"), "owner", F.col("doc_id").alias("repo")), max_owners, max_repos)
    # joined by value: only values that look live, each with few rows, so that no widely copied value is a hot key
    live = known.where("live").select(F.col("value").alias("__v"))
    marked = each.join(live, F.col("__h.value") == F.col("__v"), "left")
    span = F.struct(F.col("__h.start").alias("start"), F.col("__h.kind").alias("kind"), F.col("__h.end").alias("end"), F.col("__h.value").alias("value"), F.col("__v").isNotNull().alias("live"))
    grouped = marked.groupBy("doc_id", "owner", "text_key").agg(F.first("__n").alias("__n"), F.sort_array(F.collect_list(span)).alias("hits"))
    full = grouped.select("doc_id", "text_key", "hits", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__k")).drop("__k")
    empty = scanned.where(F.size("hits") == 0).select("doc_id", "text_key", F.array().cast("array<struct<start:int,kind:int,end:int,value:bigint,live:boolean>>").alias("hits"))
    return full.unionByName(empty).withColumn("n_live", F.size(F.filter("hits", lambda h: h["live"])).cast("long"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda h: F.concat_ws(":", F.element_at(names, h["kind"] + 1), h["start"], h["end"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base ones, and added ones that look live), n_live of each scanned row."""
    of = lambda name: F.size(F.filter("hits", lambda h: h["kind"] == ORDER[name])).cast("long").alias(f"n_{name}")
    base = F.filter("hits", lambda h: h["kind"] < len(BASE))
    told = F.filter("hits", lambda h: h["live"] | (h["kind"] < len(BASE)))
    return scanned.select("doc_id", *[of(k) for k in BASE], F.sha2(F.encode(span_text(base), "UTF-8"), 256).alias("base_sha256"), span_text(told).alias("spans"), "n_live")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span of scan() replaced by mark in text, n_chars counted anew; no row is dropped.

    Spans that overlap become one mark. Rows without a span pass as they are,
    and so does any further column, whatever its name.
    """
    names = docs.columns
    key, id_, key_, hits_ = unused(names, "key", "hit_id", "hit_key", "hits")
    found = scan(docs, **options).where(F.size("hits") > 0).groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key_)).agg(F.first("hits").alias(hits_))
    found = joinable(materialise(found, "secret-found"), most=100_000)
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key_)), "left")
    # overlapping spans become one; a text's pieces are cut by place and joined once
    merged = F.aggregate(
        hits_,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, h: F.when(
            (F.size(acc) > 0) & (h["start"] < F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], h["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(h["start"].alias("start"), h["end"].alias("end"))))),
    )

    def pieces(spans: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(spans, k - 1)["end"]).otherwise(F.lit(0))
        gaps = F.transform(spans, lambda x, k: F.substring(F.col("text"), before(k) + 1, x["start"] - before(k)))
        return F.array_join(F.concat(gaps, F.array(F.substring(F.col("text"), F.element_at(spans, -1)["end"] + 1, F.length("text")))), mark)

    text = F.when(F.col(hits_).isNotNull(), let(merged, pieces)).otherwise(F.col("text"))
    out = joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names])
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in names]) if "n_chars" in names else out
