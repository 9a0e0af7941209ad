"""Secret scans in DataFrame functions alone.

Strong candidates ("base") stand by themselves: assignments to secret names, access ids, long
hexadecimal runs. Weak candidates (a named account, a short or unnamed random value, an
endpoint; names may have a prefix as in ``DB_USER``) mean nothing alone; they are reported only where complementary parts meet. Every
part becomes an interval, widened by ``reach`` characters; parts of one document and one scope
(a paragraph between blank lines) are joined when their intervals meet. The join is an equi-join on
(row, scope, slot of ``reach`` characters), so a part meets only its neighbourhood.

A weak value is reported with an access identifier in reach, an access identifier with a secret value
(weak or strong) in reach, and an endpoint with both.

Positions are code points. They come from splitting the text at a pattern's matches: pieces and
matches alternate, so running sums of their lengths give every start. Texts are read once; what follows works on
numbers, by windows over a document's matches, and takes time in proportion to them.

Defined cases: null text is the empty text; a text without spans has the digest of the empty
string; a text of millions of characters full of matches takes time in proportion (one task has all
numbers of one document, as it has its text); equal rows are scanned each; parts that begin together
go by kind; null ids stay null; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, whole_text, written

#: The strong kinds, in the order that breaks ties.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Parts of a credential that are weak alone. ``\\b`` means ASCII word characters here, see ``_java``.
WEAK = {
    "weak_id": r"""(?i)\b(?:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""",
    "weak_value": r"""(?i)\b(?:pass|pwd|pw|key|credential|auth|private_?key|client_?secret)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""",
    "endpoint": r"(?i)\b(?:[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._~%@:/?#&=+-]{4,}|(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b)",
}
#: More weak parts, as Java patterns: names after a prefix and ``_`` (after ``-`` a word begins), strong names with values
#: too short to stand alone, and runs of 20 or more characters with small and capital letters and digits.
#: An ``access_key`` is an account name, but a secret after ``secret_``.
MORE = {
    "prefixed_id": r"""(?i)(?<=[a-z0-9]_)(?:user(?:name|_?id)?|login|account|client_?id|(?<!secret_)access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""",
    "prefixed_value": r"""(?i)(?<=[a-z0-9]_)(?:pass|pwd|pw|(?<!access_)key|(?<=secret_)access_?key|credential|auth|private_?key|client_?secret)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""",
    "short_value": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,11}(?![A-Za-z0-9+/_.=-])""",
    "random": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?=[A-Za-z0-9+/_=-]*?[a-z])(?=[A-Za-z0-9+/_=-]*?[A-Z])(?=[A-Za-z0-9+/_=-]*?[0-9])[A-Za-z0-9+/_=-]+",
}
BASE = ("assign", "access", "hex")
KINDS = [*BASE, *WEAK, *MORE]
#: What a text must hold to have a match: found faster than that there is none. Every name is followed by a colon or
#: an equals sign, and so is an endpoint's scheme or address.
NEEDS = {"access": ("AKIA",), "break": ("\n",), **{k: (":", "=") for k in ("assign", *WEAK, *MORE) if k != "random"}}
WHO, SECRET = ("weak_id", "prefixed_id", "access"), ("weak_value", "prefixed_value", "short_value", "random", "assign", "hex")
SCOPE_BREAK = r"\n[\x20\t]*\n"


def _runs(text: Column, pattern: str, needs: tuple[str, ...] = (), least: bool = False) -> Column:
    """array<struct<gap,size,value>> of a pattern's matches: the characters before each, in it, and in its group 2 (if ``least``).

    A match has one of ``needs``, if there are any.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    sizes = F.transform(whole, lambda x: F.char_length(x))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.char_length(x)) if least else sizes
    both = F.zip_with(sizes, values, lambda s, v: F.struct(s.alias("size"), v.alias("value")))
    runs = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), both, lambda g, x: F.struct(g.alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    some = F.size(whole) > 0  # texts without a match need no split
    if needs:
        some = functools.reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in needs]) & some
    return F.when(some, runs).otherwise(F.array().cast("array<struct<gap:int,size:int,value:int>>"))


def _java(pattern: str) -> str:
    """Word boundaries by ASCII, which Java's own are not in every version."""
    head, *rest = pattern.split(r"\b")
    return head + "(?<![A-Za-z0-9_])" + "(?![A-Za-z0-9_])".join(rest)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked_parts(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts, of ``rid, scope, start, rank, kind, end``, that complementary parts confirm."""
    role = (
        F.when(F.col("kind").isin(*WHO), "who").when(F.col("kind").isin(*SECRET), "secret").otherwise("where")
    )
    parts = parts.withColumn("role", role)
    # A part covers the slots of its interval; the other side also covers the reach around it.
    slot = lambda c: F.floor(c / reach)
    near = parts.select("rid", "scope", F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r")).where("r <> 'where'")
    near = near.withColumn("slot", F.explode(F.sequence(slot(F.col("s") - reach), slot(F.col("e") + reach))))
    weak = parts.where(F.col("kind").isin(*WEAK, *MORE))
    mine = weak.withColumn("slot", slot(F.col("start")))
    # The nearest interval of a pair meets the slot of the weak part's start or lies right of it
    # within reach of its end; long parts therefore cover all their slots.
    mine = mine.withColumn("slot", F.explode(F.sequence(F.col("slot"), slot(F.col("end")))))
    met = mine.join(near, ["rid", "scope", "slot"]).where((F.col("s") - reach < F.col("end")) & (F.col("start") < F.col("e") + reach) & (F.col("r") != F.col("role")))
    seen = met.groupBy("rid", "start", "rank", "kind", "end", "role").agg(
        F.max((F.col("r") == "who").cast("int")).alias("who"), F.max((F.col("r") == "secret").cast("int")).alias("secret")
    )
    sound = F.when(F.col("role") == "who", F.col("secret") == 1).when(F.col("role") == "secret", F.col("who") == 1).otherwise((F.col("who") == 1) & (F.col("secret") == 1))
    return seen.where(sound).select("rid", "start", "rank", "kind", "end")


def placed_parts(runs: DataFrame) -> DataFrame:
    """``rid, start, rank, kind, end, scope`` of every part, from ``rid`` and an array column of runs for each kind and ``break``.

    Starts are running sums by kind, scopes running counts of breaks. A part with a name inside a part that has the
    name already is none, nor is a random run that meets another part: both are tested
    against the running greatest end of the parts that begin before, so all is linear in the number of matches
    but for sorting. A document's parts stay in one partition, as its text does.
    """
    kinds = [*KINDS, "break"]

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))

    listed = F.concat(*[ranked(i, kind) for i, kind in enumerate(kinds)])
    rows = runs.select("rid", F.explode(listed).alias("x")).select("rid", "x.*").repartition("rid")
    so_far = Window.partitionBy("rid", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")
    names = F.array(*map(F.lit, kinds))
    parts = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("kind", F.get(names, F.col("rank")))
    parts = parts.where((F.col("kind") != "assign") | (F.col("value") >= 12))
    until = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    is_break, loose, bare = F.col("kind") == "break", F.col("kind").isin(*[k for k in MORE if k != "random"]), F.col("kind") == "random"
    # A break counts where it ends: at the place of the first part after it.
    ended = Window.partitionBy("rid").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("place", F.when(is_break, F.col("end")).otherwise(F.col("start")))
    parts = parts.withColumn("scope", F.count(F.when(is_break, 1)).over(ended).cast("int")).where(~is_break)
    named = ~loose & ~bare & (F.col("kind") != "endpoint")
    parts = parts.withColumn("reached", F.max(F.when(named, F.col("end"))).over(until)).where(~loose | F.col("reached").isNull() | (F.col("reached") < F.col("end")))
    back = Window.partitionBy("rid").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    left, right = F.max(F.when(~bare, F.col("end"))).over(until), F.min(F.when(~bare, F.col("start"))).over(back)
    parts = parts.withColumn("left", F.coalesce(left, F.lit(-1))).withColumn("right", right)
    meets = (F.col("left") > F.col("start")) | (F.coalesce("right", F.col("end")) < F.col("end"))
    return parts.where(~bare | ~meets).select("rid", "start", "rank", "kind", "end", "scope")


def scan(df: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``id``, ``base`` and ``spans`` (arrays of start, rank, kind, end by start) of every document, and ``rid``, its row number.

    Columns named in ``carry`` go along as ``carry0`` and so on. The texts are read once; matches are
    written as lengths, under a row number that stands for the row from then on.
    """
    named = {f"carry{i}": c for i, c in enumerate(carry or [])}
    rows = pick(df, id=id_col, text=text_col, **named).withColumn("text", whole_text(F.col("text")))
    text = F.col("text")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **{k: _java(p) for k, p in WEAK.items()}, **MORE, "break": SCOPE_BREAK}
    found = rows.select("id", *named, *[_runs(text, p, NEEDS.get(kind, ()), kind == "assign").alias(kind) for kind, p in patterns.items()])
    found = written(found.withColumn("rid", F.monotonically_increasing_id()), "matches")
    some = " or ".join(f"size(`{kind}`) > 0" for kind in KINDS)
    parts = written(placed_parts(found.where(some).select("rid", *patterns)), "parts")
    base = parts.where(F.col("kind").isin(*BASE)).select("rid", "start", "rank", "kind", "end")
    linked = linked_parts(parts, reach)
    span = F.struct("start", "rank", "kind", "end")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    # Parts of one place and kind are of one row: nothing is counted twice.
    spans = base.unionByName(linked).groupBy("rid").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*BASE), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    held = found.where(some).select("rid", "id", *named).join(spans, "rid", "left").select("rid", "id", *named, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    return found.where(f"not ({some})").select("rid", "id", *named, none.alias("base"), none.alias("spans")).unionByName(held)


def digest(scanned: DataFrame) -> DataFrame:
    """``id``, the counts by strong kind, the base spans' digest and all spans as a string."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("id", of("assign"), of("access"), of("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(scanned: DataFrame, text: str, mark: str = "[secret]", block: int = 4096) -> DataFrame:
    """The rows of ``scan`` with every span of the text column (by start; they may overlap) replaced by ``mark``.

    Texts with spans are cut into blocks of ``block`` characters, each block is masked by its own
    pieces of the spans, and the blocks are joined again: linear in text and spans.
    """
    names = scanned.columns
    flat = scanned.toDF(*["rid" if c == "rid" else f"c{i}" for i, c in enumerate(names)])
    at_text, at_spans = f"c{names.index(text)}", f"c{names.index('spans')}"
    some = F.size(at_spans) > 0
    held = flat.where(some)
    spot = held.select("rid", F.posexplode(at_spans).alias("nth", "s")).select("rid", "nth", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    before = Window.partitionBy("rid").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # A span that begins inside an earlier one brings no mark of its own, and hides only what is not hidden yet.
    spot = spot.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0))).where(F.col("end") > F.col("at"))
    spot = spot.select("rid", F.greatest("start", "at").alias("start"), "end", (F.col("start") >= F.col("at")).alias("fresh"))
    spot = spot.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    lo, hi = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("end") - F.col("block") * block, F.lit(block))
    opens = F.col("fresh") & (F.floor(F.col("start") / block) == F.col("block"))
    cuts = spot.groupBy("rid", "block").agg(F.array_sort(F.collect_list(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), opens.alias("opens")))).alias("cuts"))
    blocks = held.select("rid", F.posexplode(F.regexp_extract_all(at_text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("block", "part"))
    blocks = blocks.withColumn("block", F.col("block").cast("long")).join(cuts, ["rid", "block"], "left")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def add(acc: Column, c: Column) -> Column:
        kept = F.substring("part", acc["at"] + 1, c["lo"] - acc["at"])
        return F.struct(c["hi"].alias("at"), F.concat(acc["done"], kept, F.when(c["opens"], F.lit(mark)).otherwise("")).alias("done"))

    shown = F.aggregate("cuts", first, add, lambda acc: F.concat(acc["done"], F.substring("part", acc["at"] + 1, F.lit(block))))
    blocks = blocks.select("rid", "block", F.when(F.col("cuts").isNull(), F.col("part")).otherwise(shown).alias("part"))
    whole = blocks.groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda b: b["part"]), "").alias("new"))
    done = held.drop(at_text).join(whole, "rid").withColumnRenamed("new", at_text).select(*flat.columns)
    return flat.where(~some).unionByName(done).toDF(*names)
