r"""Secret scans, with DataFrame functions alone.

Three base kinds are found on their own: `assign`, `access` and `hex`. A text is cut at a kind's matches; the lengths of
the pieces and of the matches add up to offsets in code points, as running sums over the pieces, so no text is searched
for what was found. Patterns repeat single classes of characters only, and never a group, so that the engine walks long
runs in a loop and visits no stretch of a text twice.

Multipart credentials are linked besides. Weak candidates, which mean nothing alone, are bare key strings
(`weak_key`: a whole run of 32 to 64 characters of a key alphabet, with a digit, an upper and a lower case letter) and
endpoints (`weak_endpoint`: scheme and host of a URL, or host:port, with a dot in the host). They join the access
identifiers, the secrets and each other over intervals: within a document, parts lie in one scope if at most SCOPE code
points are between them. A weak key is reported when an access identifier or an endpoint lies in its scope, an endpoint
when an access identifier or an assigned secret does. The join is two sweeps over a document's sorted parts, one forwards
for the last complement before a candidate and one backwards for the first after it, so its work follows the number of
parts, not of pairs. Both sweeps and the offsets share one exchange by row, of a few numbers a match.

Defined cases: a null text counts as empty; every row gives one row, also when rows repeat or doc_id is null; a part
that touches or overlaps its complement is within scope; a weak key that overlaps a base span is not reported again;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import text_or_empty

SCOPE = 200
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
WEAK_KEY = r"[A-Za-z0-9+/_-]{32,}"
#: A host:port starts where a run of its characters starts, and takes all that follows of the run.
URL, HOST_PORT = r"https?://[A-Za-z0-9.-]*[A-Za-z0-9]", r"(?<![A-Za-z0-9.-])[A-Za-z0-9.-]++:[0-9]++[A-Za-z0-9.:-]*+"
#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "weak_key", "weak_endpoint")
#: Pieces of a text before the matches of a kind (rank), with the matches' lengths; those that are no spans count too.
PIECE = "array<struct<rank:int,gap:int,n:int,ok:boolean>>"


def _pieces(rank: int, pattern: str, keep, probe: str) -> Column:
    """The pieces of a kind; none at once where the probe finds nothing."""
    text = F.col("text")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches,
        lambda g, m: F.struct(F.lit(rank).alias("rank"), F.length(g).alias("gap"), F.length(m).alias("n"), keep(m).alias("ok")),
    )
    return F.when(text.rlike(probe), cut).otherwise(F.array().cast(PIECE))


def pieces() -> Column:
    """The pieces of all kinds of the column text, in order within a kind."""
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    mixed = lambda m: (F.length(m) <= 64) & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    host = lambda m: (m.rlike("^https?://") | m.rlike("^[A-Za-z0-9.-]+:[0-9]{2,5}$")) & m.rlike(r"[A-Za-z0-9-]\.[A-Za-z0-9-]") & ~m.contains("..")
    return F.concat(
        _pieces(0, ASSIGN, long_value, r"(?i)password|passwd|secret|token|api_?key"),
        _pieces(1, ACCESS, lambda m: F.length(m) >= 20, "AKIA"),
        _pieces(2, HEX, lambda m: F.lit(True), HEX),
        _pieces(3, WEAK_KEY, mixed, "[A-Za-z0-9+/_-]{32}"),
        _pieces(4, f"{URL}|{HOST_PORT}", host, r"https?://|:[0-9]{2}"),
    )


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans array<struct<start,rank,end,kind>>) of each row, sorted by start and then by kind as in KINDS."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text_or_empty().alias("text"))
    cut = rows.select("row", "doc_id", F.posexplode_outer(pieces()).alias("at", "p")).select("row", "doc_id", "at", "p.*").repartition("row")
    upto = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = cut.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("n"))
    parts = parts.withColumn("kind", F.when(F.col("ok"), F.col("rank")))
    # the same order in both directions; each frame grows by a row at a time
    before = Window.partitionBy("row").orderBy(F.asc("start"), F.asc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = {"key": (1, 4), "endpoint": (0, 1), "base": (0, 1, 2)}  # what links a weak key, what links an endpoint, and base spans
    swept = parts.withColumns({f"{name}_end": F.max(F.when(F.col("kind").isin(*ranks), F.col("end"))).over(before) for name, ranks in wanted.items()})
    swept = swept.withColumns({f"{name}_start": F.min(F.when(F.col("kind").isin(*ranks), F.col("start"))).over(after) for name, ranks in wanted.items()})

    def near(name: str) -> Column:
        back, ahead = F.col("start") - F.col(f"{name}_end") <= scope, F.col(f"{name}_start") - F.col("end") <= scope
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    inside = F.coalesce(F.col("base_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_start") < F.col("end"), F.lit(False))
    linked = F.when(F.col("kind") <= 2, True).when(F.col("kind") == 3, near("key") & ~inside).when(F.col("kind") == 4, near("endpoint"))
    names = F.array(*[F.lit(k) for k in KINDS])
    span = F.struct("start", "rank", "end", F.element_at(names, F.col("rank") + 1).alias("kind"))
    found = swept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(linked, span))).alias("spans"))
    return found.select("doc_id", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    found = scan_secrets(docs, scope)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] <= 2)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
