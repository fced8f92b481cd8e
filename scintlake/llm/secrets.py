"""Secret scans with multipart credential linking, with DataFrame expressions only.

Base rules find strong parts: assignments to secret-like names, access key ids and long hex runs. Weak parts (opaque
mixed-class tokens, short assigned values, user names and mail addresses, URLs and addresses) mean little alone. They
are reported only when complementary parts stand in one scope: a weak secret beside an identifier, a weak identifier
or an endpoint beside a reported or strong secret. Two parts share a scope when at most ``SCOPE`` code points lie between them.

Positions come from one split and one extraction per rule: gap and match lengths added up. Both see the same leftmost
non-overlapping matches; lengths are code points. Parts are narrow rows keyed by document; the link is a left semi
join on (document, cell of ``SCOPE`` code points) with an interval condition, so no pair leaves a join and no document
is gathered except as its own list of spans.

Nulls: a null text counts as empty; null ids are allowed. Rows that repeat (same id, same text) get the same spans.
Empty tables give empty results. The cost of one document grows with its length and, beyond thousands of spans, with
their square in copied array entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scintlake.session import stage

#: code points between two parts of one credential, at most
SCOPE = 160


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"       # a maximal run; shorter ones hold no match either
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
IDENT = (f"(?:{_either('user')}(?:{_either('name')})?|{_either('login')}|{_either('client')}_?{_either('id')}|{_either('account')})"
         r"""["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._-]{2,64}|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,64}\.[A-Za-z0-9.-]{2,64}""")
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{1,2000}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?"""

#: order of the kinds in a list of spans that start together
KINDS = ["assign", "access", "hex", "short", "opaque", "ident", "endpoint"]
SPAN = "struct<start:bigint,rank:int,end:bigint>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def found(text: Column, pattern: str, ranks: list[tuple[int, int, int]], group: int = 0, also=None) -> Column:
    """Spans of the matches of ``pattern``: (start, rank, end).

    A match gets the first rank of ``ranks`` = [(rank, least, most)] whose bounds hold the length of its ``group``;
    with none it is dropped. ``also`` is a further condition on the match.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["gap"])
        end = start + F.char_length(p["hit"])
        n = F.char_length(p["value"])
        rank = F.coalesce(*[F.when(n.between(a, b), F.lit(r)) for r, a, b in ranks], F.lit(None).cast("int"))
        good = p["hit"].isNotNull() & rank.isNotNull()
        if also is not None:
            good = good & also(p["hit"])
        span = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end")).cast(SPAN)
        return F.struct(F.coalesce(end, start).cast("long").alias("at"),
                        F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(_none())


def _mixed_class(hit: Column) -> Column:
    return hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")


LONG = 2**31 - 1


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, key, and the lists strong, weak, idents and endpoints of a row's spans; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = docs.select("doc_id", text.alias("text"))
    row = row.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text"))))
    row = row.withColumn("assigned", found(F.col("text"), ASSIGN, [(0, 8, LONG), (3, 4, 7)], group=2))
    row = row.withColumn("strong", F.concat(F.filter("assigned", lambda s: s["rank"] == 0),
                                            found(F.col("text"), ACCESS, [(1, 16, LONG)]), found(F.col("text"), HEX, [(2, 32, LONG)])))
    overlaps = lambda s: F.exists("strong", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    opaque = F.filter(found(F.col("text"), OPAQUE, [(4, 20, LONG)], also=_mixed_class), lambda s: ~overlaps(s))
    row = row.withColumn("weak", F.concat(F.filter("assigned", lambda s: s["rank"] == 3), opaque))
    some = (F.size("strong") > 0) | (F.size("weak") > 0)
    return row.select("doc_id", "key", "strong", "weak",
                      F.when(some, found(F.col("text"), IDENT, [(5, 1, LONG)])).otherwise(_none()).alias("idents"),
                      F.when(some, found(F.col("text"), ENDPOINT, [(6, 1, LONG)])).otherwise(_none()).alias("endpoints"))


def _near(a: DataFrame, b: DataFrame, scope: int) -> DataFrame:
    """Rows of ``a`` with a row of ``b`` in scope. ``a`` stands in the cells it touches, ``b`` also in those its margin touches."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope))).alias("cell")
    left = a.select("*", cells(F.col("start"), F.col("end")))
    right = b.select(F.col("key").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"),
                     cells(F.col("start") - scope, F.col("end") + scope)).withColumnRenamed("cell", "c")
    return (left.join(right, (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c")) & (F.col("start") - F.col("e") <= scope)
                      & (F.col("s") - F.col("end") <= scope), "left_semi")
            .select("key", "start", "rank", "end").distinct())


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Reported weak spans (key, start, rank, end)."""
    def rows(*lists: str) -> DataFrame:
        one = [parts.select("key", F.explode(c).alias("s")).select("key", "s.*") for c in lists]
        return reduce(DataFrame.unionByName, one)

    strong = rows("strong").distinct()
    idents = rows("idents").distinct()
    secrets = _near(rows("weak").distinct(), idents.unionByName(strong.filter("rank = 1")), scope)
    secrets = stage(secrets, "secret-links")     # read by both joins below
    anchors = secrets.unionByName(strong.filter("rank in (0, 2)"))
    return secrets.unionByName(_near(idents, anchors, scope)).unionByName(_near(rows("endpoints").distinct(), anchors, scope))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, ``strong`` and ``spans``, lists of (start, rank, end) by start and rank.

    ``rank`` indexes ``KINDS``. Only doc_id and text are read; other columns do not matter.
    """
    p = stage(parts(docs), "secret-parts")
    more = linked(p, scope).groupBy(F.col("key").alias("k")).agg(
        F.collect_list(F.struct("start", "rank", "end").cast(SPAN)).alias("more"))
    return (p.join(more, F.col("key") == F.col("k"), "left")
            .select("doc_id", F.array_sort("strong").alias("strong"),
                    F.array_sort(F.concat("strong", F.coalesce("more", _none()))).alias("spans")))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"),
                                                                      s["end"].cast("string"))))
