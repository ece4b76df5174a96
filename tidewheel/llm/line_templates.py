"""Line dedup by log templates: a parse tree of fixed depth, built with DataFrame functions only.

A line is cut at blanks; tokens with digits (numbers, dates, addresses, ids) are
masked as ``<*>``. The tree has a level for the token count and ``DEPTH`` levels for
the leading tokens. A leaf may hold many templates, so its lines meet in several groups: all of them,
those that agree but for one place, and those that agree in one of as many runs of places as a
template may have variable ones and one more, so that all instances of a template share a group. Lines of one group
are compared place by place: a token that at least half of the group's documents have at its place
is constant, any other place is variable and ``<*>`` in the line's template. A line with too many variable
places is no instance of that template. A line may have several templates, and its own key always counts.

A template that recurs in ``min_docs`` documents is dropped everywhere but in the
first document that has it (the smallest doc_id), so no passage is lost altogether. Two short
lines that differ in a word don't show that this word is a variable: a template with blanks for words
needs a document more, unless it has ``LONG_TOKENS`` tokens.

All lines go through the shuffle as hashes only. The words and the groups are needed just for
lines of leaves with several masked lines, each from one place that holds it; a bitmap of fixed size over those
places keeps most other lines from being masked again and out of that shuffle. Counts are partial before every
shuffle, so a line that a third of all documents share costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bitmaps import maybe_in
from tidewheel.llm.columns import let
from tidewheel.session import forget, materialize, settle

DEPTH = 3
MIN_DOCS = 2
#: Tokens from which a template with blanks for words needs no more documents than an exact line.
LONG_TOKENS = 20
#: Lines of fewer tokens are left out unless the caller asks for them; they are never masked.
MIN_TOKENS = 3
#: Share of constant places that an instance of a template must have.
SIMILARITY = 0.7
BLANK = "<*>"
#: Signs, but for two blanks, that make a line differ from its masked form; single signs are looked up in one table.
ODD = r"[\t\r0123456789]"


def masked(line: Column) -> Column:
    """Tokens with one blank between them, those with digits as ``<*>``; most lines need neither pattern.

    A line of one or two tokens keeps its digits: with a blank it would have too few constant places.
    """
    uneven = line.contains("\t") | line.contains("\r") | line.contains("  ")
    own = F.trim(F.when(uneven, F.regexp_replace(line, r"[\x20\t\r]+", " ")).otherwise(line))
    # A token is looked at once, from its start.
    changed = F.when(own.rlike("[0-9]") & own.rlike(r"\x20[^\x20]*\x20"), F.regexp_replace(
        own, r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+", BLANK)).otherwise(own)
    # A line without these signs, as most are, is read twice and not four times.
    return F.when(line.contains("  ") | line.rlike(ODD), changed).otherwise(F.trim(line))


def _parsed(rows: DataFrame, min_tokens: int) -> DataFrame:
    """``raw`` as line (masked), leaf and key, for lines of at least ``min_tokens`` tokens; no higher-order function, which would be interpreted."""
    # A filter does not go below a generator, so lines are masked once.
    lines = rows.select(*[c for c in rows.columns if c != "raw"], F.explode(F.array(masked(F.col("raw")))).alias("line")).filter(F.col("line") != "")
    count = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    if min_tokens > 1:
        lines = lines.filter(count >= min_tokens)
    return lines.select("*", F.xxhash64(count, F.substring_index("line", " ", DEPTH)).alias("leaf"), F.xxhash64("line").alias("key"))


def lines_of(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, body (hash of the text), pos (from 0), line (masked), leaf, key of each line of at least ``min_tokens`` tokens."""
    own = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("body"), F.split("text", "\n").alias("lines"))
    return _parsed(own.select("doc_id", "body", F.posexplode("lines").alias("pos", "raw")), min_tokens)


#: What names a line; the lines of several texts of one doc_id may share a place.
PLACE = ("doc_id", "pos")


def _held_lines(docs: DataFrame, variants: DataFrame) -> DataFrame:
    """leaf, key, line of the places ``at`` of ``variants``, and maybe of others; only these lines are masked again."""
    # No column but doc_id goes through the generator, which would copy or hash the text for each line.
    raw = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    placed = raw.withColumn("at", F.xxhash64(*PLACE)).filter(maybe_in(variants, "at"))
    return _parsed(placed.select("raw"), MIN_TOKENS).select("leaf", "key", "line")


def _groups(tokens: Column) -> Column:
    """Hashes of the groups of a line within its leaf, from its tokens; the leading ``DEPTH`` are the same in all of them."""
    def of_rest(hashes: Column) -> Column:
        n = F.size(hashes)
        runs = F.least(n, F.floor(F.round((n + DEPTH) * (1 - SIMILARITY), 6)).cast("int") + 1)
        # Named once: inside the lambda over the places it would be folded anew for each of them.
        but_one = let(F.aggregate(hashes, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)), lambda whole: F.transform(
            hashes, lambda h, i: F.xxhash64(F.lit("but"), i, whole.bitwiseXOR(h))))

        def of_runs(count: Column) -> Column:
            bound = lambda k: F.floor(k * n / count).cast("int")
            return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.xxhash64(F.lit("run"), k, F.slice(hashes, bound(k) + 1, bound(k + 1) - bound(k))))

        own_run = F.when(n > 1, let(runs, of_runs)).otherwise(F.array().cast("array<bigint>"))
        return F.concat(F.array(F.xxhash64(F.lit("all"))), but_one, own_run)

    return let(F.transform(F.slice(tokens, DEPTH + 1, F.size(tokens)), lambda t, i: F.xxhash64(i, t)), of_rest)


def _grouped(variants: DataFrame) -> DataFrame:
    """leaf, key, line, docs, group, group_docs of masked lines (leaf, key, line, docs), one row for each group with other lines.

    Groups of the same lines of a leaf count once.
    """
    own = F.transform(_groups(F.split("line", " ")), lambda g: F.xxhash64("leaf", g))
    held = materialize(variants.select("key", "docs", own.alias("groups")), "groups")
    member = held.select("key", "docs", F.explode("groups").alias("group"))
    # A key is of one leaf, so the keys of a group tell its leaf.
    sizes = member.groupBy("group").agg(F.count(F.lit(1)).alias("kinds"), F.sum("docs").alias("group_docs"),
                                        F.bit_xor(F.xxhash64("key")).alias("own")).filter(F.col("kinds") > 1)
    chosen = materialize(sizes.groupBy("kinds", "group_docs", "own").agg(F.min("group").alias("group")).select("group", "group_docs"), "chosen")
    # Most groups hold one line alone; the bitmap keeps them out of the shuffle.
    shared = member.select("key", "group").filter(maybe_in(chosen, "group"))
    grouped = materialize(shared.join(chosen, "group").join(variants, "key"), "grouped")
    forget(held, chosen)
    return grouped


def _by_place(constants: Column) -> Column:
    """The constant tokens (place, token; ascending) as an array by place, with empty texts between them; of two at a place the greater."""
    def last(own: Column) -> Column:
        return F.filter(own, lambda c, i: F.coalesce(F.get(own, i + 1)["place"] != c["place"], F.lit(True)))

    def spread(own: Column) -> Column:
        blanks = lambda c, i: F.repeat(F.lit(" "), c["place"] - F.coalesce(F.get(own, i - 1)["place"], F.lit(0)))
        return F.split(F.array_join(F.transform(own, lambda c, i: F.concat(blanks(c, i), c["token"])), ""), " ")

    return let(let(constants, last), spread)


def _templates(grouped: DataFrame) -> DataFrame:
    """leaf, key, docs, share (of constant places), template, more (documents it needs beyond others) of each line in each of its groups."""
    # The leading tokens are those of the leaf.
    placed = grouped.select("group", "group_docs", "docs", F.posexplode(F.split("line", " ")).alias("place", "token")).filter(F.col("place") >= DEPTH)
    support = placed.groupBy("group", "group_docs", "place", "token").agg(F.sum("docs").alias("held"))
    # A line has one token at a place, so no more than two tokens are constant there: both, if each has half of the documents.
    shapes = support.filter((2 * F.col("held") >= F.col("group_docs")) & (F.col("held") > 1)).groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct("place", "token"))).alias("constants")).select("group", _by_place(F.col("constants")).alias("shape"))
    template = F.transform(F.split("line", " "), lambda own, i: F.when((i < DEPTH) | (F.get("shape", i) == own), own).otherwise(F.lit(BLANK)))
    # No constant place, no shape.
    joined = grouped.join(shapes, "group", "left").select("leaf", "key", "docs", "line", template.alias("places")).select(
        "leaf", "key", "docs", "line", F.array_join("places", " ").alias("template"), F.size("places").alias("size"),
        F.size(F.array_remove("places", BLANK)).alias("constant"))
    return joined.select("leaf", "key", "docs", (1 - (F.col("size") - F.col("constant")) / F.col("size")).alias("share"), "template",
                         ((F.col("size") < LONG_TOKENS) & (F.col("template") != F.col("line"))).cast("int").alias("more"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, body and the positions of dropped lines, for texts that lose any."""
    hashed = materialize(lines_of(docs, min_tokens).select("doc_id", "body", "pos", "leaf", "key"), "lines")
    once = hashed.groupBy("leaf", "key", "doc_id").agg(F.min("pos").alias("pos"))
    # Of the places of a line that in the document of the least hash, so that few documents hold all lines.
    variants = once.withColumn("holder", F.xxhash64("doc_id")).groupBy("leaf", "key").agg(
        F.count(F.lit(1)).alias("docs"), F.min_by(F.xxhash64(*PLACE), "holder").alias("at"), F.min("holder").alias("holder"))
    leaves = variants.groupBy("leaf").agg(
        F.sum("docs").alias("leaf_docs"), F.count(F.lit(1)).alias("kinds")).filter(F.col("leaf_docs") >= min_docs)
    crowded = materialize(variants.join(leaves, "leaf"), "leaves")
    mixed = crowded.filter(F.col("kinds") > 1)
    holders = docs.withColumn("holder", F.xxhash64("doc_id")).filter(maybe_in(mixed, "holder")).drop("holder")
    words = _held_lines(holders, mixed).groupBy("leaf", "key").agg(F.first("line").alias("line"))
    variants = materialize(mixed.join(words, ["leaf", "key"]).select("leaf", "key", "docs", "line"), "variants")
    grouped = _grouped(variants)
    forget(variants)
    # Shuffles of what is stored go, as those of the next steps may take as much disk again.
    settle(docs.sparkSession)
    templates = _templates(grouped)
    # Every line goes by its key too: the copies of one line recur, whatever becomes of its template.
    named = materialize(crowded.filter(F.col("docs") >= min_docs).select("key", F.col("key").alias("name"), "docs", F.lit(0).alias("more")).union(
        templates.filter(F.col("share") >= SIMILARITY).select(
            "key", F.xxhash64("leaf", "template").alias("name"), "docs", "more").distinct()), "templates")
    forget(grouped)
    # A document may have several lines of one template: first by their sum, then by documents.
    likely = named.groupBy("name").agg(F.sum("docs").alias("n"), F.max("more").alias("least")).withColumn(
        "least", F.col("least") + min_docs).filter(F.col("n") >= F.col("least")).select("name", "least")
    hits = materialize(hashed.select("doc_id", "body", "pos", "key").join(named.join(likely, "name").select("key", "name", "least"), "key"), "hits")
    forget(hashed, crowded, named)
    settle(docs.sparkSession)
    recurring = hits.groupBy("name").agg(
        F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("kept_in"), F.first("least").alias("least")).filter(
        F.col("n") >= F.col("least")).select("name", "kept_in")
    return hits.join(recurring, "name").filter(F.col("doc_id") != F.col("kept_in")).groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_set("pos")).alias("dropped"))


def _without(lines: Column, dropped: Column) -> Column:
    """The lines but for the dropped places, as the runs between them."""
    def between(own: Column) -> Column:
        bounds = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(own)))
        return let(bounds, lambda bound: F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.slice(
            own, bound[i] + 2, bound[i + 1] - bound[i] - 1))))

    return let(lines, between)


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and ``n_dropped``, the number of lines lost.

    A document that several rows name counts once, and each of its texts loses its own lines. A null or empty text stays as it is, as does a row
    without doc_id; a text of nothing but dropped lines becomes empty. Further columns stay, but for one named ``n_dropped``.
    """
    docs = docs.drop("n_dropped")
    lost = dropped_lines(docs.select("doc_id", "text"), min_docs, min_tokens).select(
        F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), F.col("dropped").alias("_dropped"))
    joined = docs.join(lost, (docs["doc_id"] == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_body")), "left")
    kept = F.concat_ws("\n", _without(F.split("text", "\n"), F.col("_dropped")))
    return joined.withColumns({
        "text": F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept),
        "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)),
    }).select(*docs.columns, "n_dropped")
