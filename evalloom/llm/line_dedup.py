"""Line dedup: an exact set-similarity join of lines, in DataFrame operations alone.

A line's tokens are its distinct words. Tokens are ordered by rarity: how many tokens of all distinct lines share their
hash bucket, of 2**17 buckets, so the table that is looked up has the same size at any scale and reaches the tasks as a
literal of small numbers; ties keep a fixed order by hash. Lines that are similar share a token among their rarest, so only those prefixes
meet. A semi join under a positional filter (which implies the bound on lengths) and bit filters leaves the lines that have a candidate at a token; it
makes at most a row for each token of a prefix. These lines are dealt to tiles by token (a hot token to many tiles), and a
tile counts each line's links in its own arrays: a pair is verified on its whole sets of words, at the first token that
both prefixes share and nowhere else. No pair is ever a row. A line is removed if an earlier one (by id, then line
number) equals it or reaches the similarity.

Equal lines are one class before the join. Order keys may collide; that can add candidates but never lose one, and
verification compares the words themselves.

Defined cases: a null text has no lines; lines without words are kept and linked with nothing. A null id comes after all
others. Rows that repeat an id are ordered by id and line number only: nothing else tells an earlier row from a later
one, so of lines with one id, number and text none goes. Lines of any length take part whole. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.shared import cut, discard, free_name, tiles

#: Buckets of the rarity table, as a power of two.
BUCKET_BITS = 17
#: Levels of rarity that buckets are ranked in; six bits of a word's key.
LEVELS = 64
#: The similarity as a fraction, so that bounds are whole numbers.
SIMILARITY = (4, 5)
BLANKS = " \t\x0b\x0c\r"
#: Blanks that part words besides a single space.
ODD = ("  ", "\t", "\x0b", "\x0c", "\r")
#: Line numbers stay below this in the order of lines, which starts from the smallest id there can be.
LINES = 1 << 31
LOWEST = 1 << 63
#: Lines of more words have 128 parity bits, not 64.
LONG = 60
#: Lines of a tile's block.
BLOCK = 512


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b)).cast("long")


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, h1, h2, at): at orders lines by id and number; the two hashes stand for the line, 128 bits.

    Arrays are made into rows by the outer forms throughout: for the others Spark adds a filter that they aren't empty, which
    makes them once more.
    """
    text, id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    start = (F.coalesce(id.cast("decimal(20,0)"), number(LOWEST)) + number(LOWEST)) * number(LINES)
    out = docs.where(text.isNotNull()).select(id.alias("id"), start.cast("decimal(38,0)").alias("start"), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))
    out = out.withColumn("line", F.btrim("line", F.lit(BLANKS)))
    return out.select("id", "line_no", "line", *line_hashes(), (F.col("start") + F.col("line_no")).cast("decimal(38,0)").alias("at"))


def line_hashes() -> list[Column]:
    """h1 and h2 of the column line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(9), "line").alias("h2")]


def number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def words(text: Column) -> Column:
    """A trimmed line's words. Splitting at single spaces is cheaper than at a pattern, so lines with other blanks go apart."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in ODD])
    return F.when(odd, F.split(text, r"[\x20\x09-\x0D]+")).otherwise(F.split(text, " "))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def rarity_table(classes: DataFrame) -> Column:
    """A literal array: for each bucket a level below `LEVELS` on a scale of logarithms, from the emptiest to the fullest bucket's words of all distinct lines.

    Words are what single spaces part here; the few that other blanks part only lose their place in the order.
    """
    each = classes.select(F.explode_outer(F.split("line", " ")).alias("t")).groupBy(bucket(F.xxhash64("t")).alias("b")).count()
    full = classes.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").alias("b")).join(each, "b", "left")
    size = F.floor(F.log2(F.coalesce(F.col("count"), F.lit(0)) + 1) * 64).cast("int")
    in_order = F.sort_array(F.collect_list(F.struct("b", size.alias("size"))))
    sizes = full.agg(F.transform(in_order, lambda x: x["size"]).alias("sizes")).first()[0]
    low, top = min(sizes), max(sizes) + 1
    return F.from_json(F.lit("[" + ",".join(str((x - low) * LEVELS // (top - low)) for x in sizes) + "]"), "array<bigint>")


def order_key(table: Column, h: Column) -> Column:
    """A word's place in the order of rarity, from its hash: its bucket's level, then the hash."""
    return F.shiftleft(F.get(table, bucket(h)), 57).bitwiseOR(F.shiftrightunsigned(h, 7))


def prefixes(classes: DataFrame, table: Column, similarity: tuple[int, int]) -> DataFrame:
    """(key, cid, spot, parity, more, prev): the rarest words of each line, as many as similar lines must share one of.

    spot holds the line's number of words and, in the lower 32 bits, the word's place among them; prev is the key before it.
    Each word flips one bit of parity; in lines of over `LONG` words, where 64 bits say little, those of half the words flip
    one of `more` as well.
    """
    num, den = similarity
    hashes = F.array_distinct(F.transform(words(F.col("line")), lambda t: F.xxhash64(t)))
    ranked = classes.select("cid", F.sort_array(F.transform(hashes, lambda h: order_key(table, h))).alias("keys"))
    rows = ranked.select("cid", "keys", parity("keys", F.lit(1).cast("long")).alias("parity"), F.size("keys").cast("long").alias("n"))
    more = F.when(F.col("n") > LONG, parity("keys", lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(1)))).otherwise(F.lit(0).cast("long"))
    first = F.slice("keys", F.lit(1), (F.col("n") - ceil_div(F.col("n") * num, den) + 1).cast("int"))
    alone = F.array(F.xxhash64("keys"))  # so short that only equal sets are similar
    chosen = F.when(F.col("n") * den < (F.col("n") + 1) * num, alone).otherwise(first)
    out = rows.select("cid", "n", "parity", more.alias("more"), chosen.alias("keys"))
    out = out.select("cid", "n", "parity", "more", "keys", F.posexplode_outer("keys").alias("place", "key"))
    #: cid and parity as expressions, so that both sides of a self-join have one plan and read one shuffle, and never null,
    #: so that no filter for nulls makes the words again.
    zero = F.lit(0).cast("long")
    prev = F.coalesce(F.get("keys", F.col("place") - 1), zero)
    spot = F.shiftleft("n", 32).bitwiseOR(F.col("place").cast("long"))
    return out.select(F.coalesce("key", zero).alias("key"), F.coalesce("cid", F.lit(-1)).alias("cid"), spot.alias("spot"), F.coalesce("parity", zero).alias("parity"), F.coalesce("more", zero).alias("more"), prev.alias("prev"))


def parity(keys: str, one: Column | Callable[[Column], Column]) -> Column:
    """64 bits, each of them flipped by the words whose keys end in its number; `one` is 1 for the words that count, else 0."""
    flip = lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", one(k) if callable(one) else one, k.bitwiseAND(F.lit(63)).cast("int")))
    return F.aggregate(keys, F.lit(0).cast("long"), flip)


def words_of(spot: Column) -> Column:
    return F.shiftright(spot, 32)


def place_of(spot: Column) -> Column:
    return spot.bitwiseAND(F.lit(2**32 - 1))


def may_link(a: dict[str, Column], b: dict[str, Column], similarity: tuple[int, int]) -> Column:
    """The filters of two lines that meet at a word: bits, position (which holds for no other lengths), more bits, not met at the word before it in both.

    The cheapest that few pairs pass comes first.
    """
    num, den = similarity
    na, nb, pa, pb = a["n"], b["n"], a["place"], b["place"]
    differ, more = a["parity"].bitwiseXOR(b["parity"]), a["more"].bitwiseXOR(b["more"])
    #: Each word that only one line has flips one bit, so lines that share many words differ in few bits.
    alike = lambda count: count * (num + den) <= (na + nb) * (den - num)
    short = F.least(na, nb) * den < (F.least(na, nb) + 1) * num
    place = (F.least(na - pa, nb - pb) * (num + den) >= (na + nb) * num) | short
    #: In long lines `more` splits the words, and with them the bits, in two: 128 bits.
    longer = (na <= LONG) | (nb <= LONG) | alike(F.bit_count(more) + F.bit_count(differ.bitwiseXOR(more)))
    new = (a["prev"] != b["prev"]) | (pa == 0) | (pb == 0)
    return alike(F.bit_count(differ)) & place & longer & new


def with_candidates(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The rows of prefixes that another line's row passes all filters with, at the same key."""
    seat = ("cid", "spot", "parity", "more", "prev")
    one, other = (rows.select("key", *[F.col(c).alias(f"{c}_{side}") for c in seat]) for side in "ab")
    a, b = ({c: F.col(f"{c}_{side}") for c in ("cid", "parity", "more", "prev")} | {"n": words_of(F.col(f"spot_{side}")), "place": place_of(F.col(f"spot_{side}"))} for side in "ab")
    found = one.join(other.hint("merge"), (one["key"] == other["key"]) & may_link(a, b, similarity) & (a["cid"] != b["cid"]), "left_semi")
    return found.select("key", *[F.col(f"{c}_a").alias(c) for c in seat])


def count_links(tile: Column, similarity: tuple[int, int]) -> Column:
    """array<struct<cid, n, late>> of a tile's lines with links: how many each has, and whether one leads to an earlier line.

    Lines a and b of a tile of two blocks are compared across, lines a of a tile of one block among themselves.
    """
    num, den = similarity
    across = tile["across"]

    def link(x: Column, y: Column) -> Column:
        """0 for none, 1 if y is earlier, 2 if x is."""
        first = ~F.arrays_overlap(x["before"], y["before"])  # else the pair has met at a rarer key
        enough = F.size(F.array_intersect(x["words"], y["words"])) * (num + den) >= (F.size(x["words"]) + F.size(y["words"])) * num
        return F.when(may_link(x, y, similarity) & (x["cid"] != y["cid"]) & first & enough, F.when(y["at"] < x["at"], 1).otherwise(2)).otherwise(0)

    def counted(x: Column, own: Column, late: int) -> Column:
        return F.struct(x["cid"].alias("cid"), F.size(F.array_remove(own, 0)).alias("n"), F.array_contains(own, late).alias("late"))

    def compare(t: Column) -> Column:
        rows = F.transform(t["a"], lambda x, i: F.transform(t["b"], lambda y, j: F.when(across | (i < j), link(x, y)).otherwise(0)))
        return F.transform(F.array(F.struct(t["a"].alias("a"), t["b"].alias("b"), rows.alias("rows"))), ends)[0]

    def ends(t: Column) -> Column:
        left = F.transform(t["a"], lambda x, i: counted(x, F.get(t["rows"], i), 1))
        right = F.transform(t["b"], lambda y, j: counted(y, F.transform(t["rows"], lambda row: F.get(row, j)), 2))
        return F.filter(F.concat(left, right), lambda x: x["n"] > 0)

    return compare({"a": tile["a"], "b": F.when(across, tile["b"]).otherwise(tile["a"])})


def similar_lines(classes: DataFrame, similarity: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """(cid, n_links, late, h1, h2, at): how many distinct lines reach the similarity with each line, and whether one of them comes first."""
    table = rarity_table(classes)
    live = cut(with_candidates(prefixes(classes, table, similarity), similarity), "candidates")
    dealt = tiles(live, ["key"], F.xxhash64("cid"), block).select("cid", F.struct("key", "spot", "parity", "more", "prev", "_lo", "_hi", "_block").alias("seat"))
    seats = dealt.groupBy("cid").agg(F.collect_list("seat").alias("seats"))
    #: A line as its distinct words, parted by single spaces.
    lines = seats.hint("merge").join(classes.select("cid", "line", "at"), "cid")
    asked = cut(lines.select("cid", "at", *line_hashes(), "seats", F.array_join(F.array_distinct(words(F.col("line"))), " ").alias("text")), "asked", "zstd")
    discard(live)
    seats = asked.select("cid", "at", "text", F.explode_outer("seats").alias("seat"), F.transform("seats", lambda x: x["key"]).alias("keys"))
    #: A line's own rarer keys at which it has a candidate. A similar pair's first common key is among both lines' keys.
    before = F.filter("keys", lambda k: k < F.col("seat.key"))
    seats = seats.select("seat.*", F.struct("cid", "at", "text", "seat.spot", "seat.parity", "seat.more", "seat.prev", before.alias("before")).alias("m"))
    left, right = F.when(F.col("_block") == F.col("_lo"), F.col("m")), F.when((F.col("_block") == F.col("_hi")) & (F.col("_lo") < F.col("_hi")), F.col("m"))
    held = seats.groupBy("key", "_lo", "_hi").agg(F.collect_list(left).alias("left"), F.collect_list(right).alias("right"))

    def split(m: Column) -> Column:
        return F.struct(*[m[c].alias(c) for c in ("cid", "at", "parity", "more", "prev", "before")], words_of(m["spot"]).alias("n"), place_of(m["spot"]).alias("place"), F.split(m["text"], " ").alias("words"))

    #: Bound once, so that each line is split once in a tile.
    tile = F.array(F.struct((F.col("_lo") < F.col("_hi")).alias("across"), F.transform("left", split).alias("a"), F.transform("right", split).alias("b")))
    found = held.select(F.explode_outer(F.flatten(F.transform(tile, lambda t: count_links(t, similarity)))).alias("x")).where("x is not null").select("x.*")
    linked = found.groupBy("cid").agg(F.sum("n").cast("long").alias("n_links"), F.max("late").alias("late"))
    linked = cut(linked.join(asked.select("cid", "h1", "h2", "at"), "cid"), "linked", "zstd")
    discard(asked)
    return linked


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per line: id, line_no, first_id and first_line_no (its class: the first equal line), n_links (other distinct lines that are similar), removed.

    A class id is null for lines without words.
    """
    lines = split_lines(docs, id_col, text_col)
    classes = lines.where("line <> ''").groupBy("line").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "lines", "zstd")
    linked = similar_lines(classes, similarity)
    #: What is known of a class: that it has copies, that it has links, or both.
    copied = classes.where("copies > 1").select(*line_hashes(), "at", F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("late"))
    known = copied.unionByName(linked.select("h1", "h2", "at", "n_links", "late")).groupBy("h1", "h2").agg(F.min("at").alias("at"), F.max("n_links").alias("n_links"), F.max("late").alias("late"))
    place = F.col("at") % number(LINES)
    whole = ((F.col("at") - place) / number(LINES)).cast("decimal(20,0)") - number(LOWEST)
    first = F.struct(F.when(whole < number(LOWEST), whole).cast("long").alias("id"), place.cast("int").alias("line_no")).alias("first")
    known = cut(known.select("h1", "h2", first, "n_links", "late"), "known")
    discard(classes, linked)
    plain = lines.select("id", "line_no", "h1", "h2", (F.col("line") != "").alias("words"))
    own = F.struct("id", "line_no")
    out = plain.join(known, ["h1", "h2"], "left").withColumn("first", F.when(F.col("words"), F.coalesce("first", own)))
    #: The first of a line's class is this line or an earlier one.
    copy = F.col("words") & ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no")))
    return out.select(F.col("id").alias(id_col), "line_no", F.col("first.id").alias("first_id"), F.col("first.line_no").alias("first_line_no"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("late") | copy, F.lit(False)).alias("removed"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs without the removed lines; all columns stay, ids must tell rows apart."""
    own, places = free_name(docs, "_id"), free_name(docs, "_gone")
    gone = judge_lines(docs, id_col, text_col, similarity).where("removed").groupBy(F.col(id_col).alias(own)).agg(F.collect_set("line_no").alias(places))
    kept = F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda x, i: ~F.array_contains(places, i))
    both = docs.join(gone, F.col(id_col).eqNullSafe(F.col(own)), "left")
    return both.withColumn(text_col, F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop(own, places)
