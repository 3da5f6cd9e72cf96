"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Patterns give spans: three base kinds, and as candidates of the method long unbroken tokens outside
them. The values of all spans are hashed and counted over the corpus by distinct owners and
repositories. A value that one owner keeps to itself looks live; one that several owners hold is a
copied example. Base spans stay whatever the verdict; a candidate adds a span only if it looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SALTS, attach, settle, size_of, text_key, text_of, unclashed

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
# Candidates of the method: long unbroken tokens that mix capitals, small letters and digits, or that are
# letters of one case with at least four digits and nothing else.
TOKEN = r"([A-Za-z0-9+/_=-]{24,})"
PLAIN, FOUR_DIGITS = r"^([A-Z0-9]+|[a-z0-9]+)$", r"([0-9][^0-9]*){4}"
LEAST_VALUE = 6
MOST_OWNERS = 1
BASE_KINDS = ("assign", "access", "hex")
TOKEN_RANK = len(BASE_KINDS)
BLOCK = 1024


def _candidate(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return mixed | (value.rlike(PLAIN) & value.rlike("[A-Za-z]") & value.rlike(FOUR_DIGITS))


def matches(text: Column, rank: int, pattern: str, value_group: int, wanted) -> Column:
    """``array<struct<rank, i, gap, length, hash>>`` of all leftmost matches; hash is null unless the value is wanted.

    The pieces between matches and the matches themselves alternate, so places are running lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    between = F.split(text, pattern, -1)
    # a split's pieces are one more than the matches
    paired = F.zip_with(F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda gap, m: F.struct(
        F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("length"))), values,
        lambda at, v: F.struct(at["gap"].alias("gap"), at["length"].alias("length"), F.when(wanted(v), F.sha2(v, 256)).alias("hash")))
    numbered = F.transform(paired, lambda m, i: F.struct(
        F.lit(rank).alias("rank"), i.alias("i"), m["gap"].alias("gap"), m["length"].alias("length"), m["hash"].alias("hash")))
    none = F.array().cast("array<struct<rank:int,i:int,gap:bigint,length:bigint,hash:string>>")
    return F.when(text.rlike(pattern), numbered).otherwise(none)


def scan(t: Column) -> Column:
    """Matches of all kinds in a text."""
    always = lambda v: F.lit(True)
    return F.concat(
        matches(t, 0, ASSIGN, 2, lambda v: F.length(v) >= LEAST_VALUE), matches(t, 1, ACCESS, 1, always),
        matches(t, 2, HEX, 1, always), matches(t, TOKEN_RANK, TOKEN, 1, _candidate))


def spans(found: DataFrame, row: str, matched: str) -> DataFrame:
    """The rows of ``found`` once per span, with ``(rank, start, end, hash)`` in code points, end exclusive.

    Places are running sums over the matches of a kind; a candidate inside a base span is that span's value and
    left out. Work and memory are linear in the matches of a text, which no text is read for.
    """
    each = found.select(*(f"`{c}`" for c in found.columns if c != matched), F.inline(matched))
    kind = Window.partitionBy(row, "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(kind)).withColumn("start", F.col("end") - F.col("length"))
    placed = placed.filter(F.col("hash").isNotNull()).drop("i", "gap", "length")
    before = Window.partitionBy(row).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.max(F.when(F.col("rank") < TOKEN_RANK, F.col("end"))).over(before)
    inside = placed.withColumn("__upto", upto)
    return inside.filter((F.col("rank") < TOKEN_RANK) | F.col("__upto").isNull() | (F.col("__upto") < F.col("end"))).drop("__upto")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, owners, repositories)`` of ``(hash, owner, repository)``.

    Distinct pairs are made first, so a widely copied example is many small groups, not one large one.
    """
    pairs = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def judged(each: DataFrame) -> DataFrame:
    """The spans with ``live``: whether at most ``MOST_OWNERS`` owners hold their value, in however many repositories."""
    verdicts = settle(ownership(each).select("hash", (F.col("owners") <= MOST_OWNERS).alias("live")))
    return attach(each, verdicts, ["hash"])


def secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keep, n_assign, n_access, n_hex, base, live, owned)`` with one row per row of ``docs``.

    ``base``, ``live`` and ``owned`` are arrays of (start, rank, end), sorted; rank numbers the kinds ``assign``,
    ``access``, ``hex`` and ``token``. ``live`` are the spans that the method adds, ``owned`` all spans of either whose
    value one owner keeps to itself. Null and empty texts have none. Rows are told apart by an own number, so
    repeated rows and null keys stay apart; a null owner or repository is one of its own. The texts are read
    once; what is counted and joined after that holds neither text nor values.
    """
    columns = {f"__keep_{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}
    found = settle(docs.select(
        *(c.alias(n) for n, c in columns.items()), F.monotonically_increasing_id().alias("__row"), scan(text_of(F.col(f"`{text}`"))).alias("__matches"),
        F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{repository}`").cast("string").alias("repository")))
    each = settle(spans(found.filter(F.size("__matches") > 0).select("__row", "owner", "repository", "__matches"), "__row", "__matches"))
    is_base = F.col("rank") < TOKEN_RANK
    at = F.struct("start", "rank", "end")
    told = judged(each).groupBy("__row").agg(
        *(F.count_if(F.col("rank") == rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE_KINDS)),
        *(F.array_sort(F.collect_list(F.when(chosen, at))).alias(name) for name, chosen in (
            ("base", is_base), ("live", ~is_base & F.col("live")), ("owned", F.col("live")))))
    joined = found.select("__row", *columns).join(told, "__row", "left")
    none = F.array().cast(told.schema["base"].dataType)
    return joined.select(
        *(F.col(n).alias(c) for n, c in zip(columns, keep)),
        *(F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in BASE_KINDS),
        *(F.coalesce(name, none).alias(name) for name in ("base", "live", "owned")))


def listed(found: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in (*BASE_KINDS, "token")))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, blocks: Column, cuts: Column, mask: str) -> Column:
    """The text, given also in blocks of ``BLOCK`` code points, with what the cuts name replaced by the mask.

    Cuts are sorted (start, end, upto), ``upto`` the largest end before: overlapping ones get one mask. A piece is
    taken from its blocks alone, so the work grows with the text and with the cuts, not with their product.
    """
    def piece(a: Column, b: Column) -> Column:
        first, last = F.floor(a / F.lit(BLOCK)).cast("int"), F.floor((b - 1) / F.lit(BLOCK)).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.when(b > a, F.substring(near, (a - first * BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    pieces = F.transform(cuts, lambda s: F.when(s["start"] >= s["upto"], F.concat(piece(s["upto"], s["start"]), F.lit(mask))).otherwise(""))
    upto = F.array_max(F.transform(cuts, lambda s: s["end"]))
    return F.when(F.size(cuts) > 0, F.concat(F.array_join(pieces, ""), piece(upto, F.length(text).cast("long")))).otherwise(text)


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", mask: str = "<secret>") -> DataFrame:
    """The rows of ``docs`` with base spans and live candidates masked in their text; null texts stay null.

    Which candidates are live is decided over the whole table; places are brought back by text, so repeated rows
    are masked alike, and a text that very many rows share is split over salts unless all places are small. Columns
    may have any names; an empty table gives an empty result.
    """
    docs, names = unclashed(docs)
    text, owner, repository = names[text], names[owner], names[repository]
    t1, t2 = text_key(F.col(f"`{text}`"))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), t1.alias("t1"), t2.alias("t2"), F.col(f"`{owner}`").cast("string").alias("owner"),
        F.col(f"`{repository}`").cast("string").alias("repository"), scan(text_of(F.col(f"`{text}`"))).alias("matches"))
    found = settle(found.filter(F.size("matches") > 0))
    each = settle(spans(found, "row", "matches"))
    cuts = judged(each).filter((F.col("rank") < TOKEN_RANK) | F.col("live")).select("t1", "t2", "start", "end").distinct()
    before = Window.partitionBy("t1", "t2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    placed = cuts.withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    cuts = settle(placed.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "upto"))).alias("cuts")))
    spark = docs.sparkSession
    keyed = docs.withColumns({"t1": t1, "t2": t2})
    if size_of(spark, cuts.select("t1", F.explode("cuts"))) <= BROADCAST_BYTES:
        told = keyed.join(F.broadcast(cuts), ["t1", "t2"], "left")
    else:
        copies = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        turn = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        told = keyed.withColumn("salt", turn).join(copies, ["t1", "t2", "salt"], "left")
    t = text_of(F.col(f"`{text}`"))
    cut = told.withColumn("blocks", F.when(F.size("cuts") > 0, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    hidden = F.when(F.col(f"`{text}`").isNotNull(), F.when(F.col("cuts").isNull(), t).otherwise(masked(t, F.col("blocks"), F.col("cuts"), mask)))
    return cut.select(*(hidden.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns)).toDF(*names)
