"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base identifiers (e-mail and IP addresses, card and phone numbers) are found by regular
expressions; they are the seeds. The words beside a seed are lexical patterns, one to
its left and one to its right. What else could be an identifier is a candidate: every run
of numbers parted by spaces, brackets, dots, slashes or hyphens, every group of digits and
hex digits parted by colons, and every other token that is more than letters with
punctuation around them. A candidate overlaps no seed, and a token no run. On the
bipartite graph of patterns and instances (seeds and candidates), scores are passed to and
fro:

* a pattern's confidence for a kind is the mass of that kind's instances beside it,
  divided by how often its word occurs in the whole corpus; it counts only when at least
  ``MIN_SUPPORT`` different instances support it, so copies of a text do not help;
* a candidate's score for a kind is the noisy-or of the confidences of its patterns. Each
  side counts less if the candidate often stands beside other words there, and the more so
  the shorter it is: a long number is the same thing everywhere, a 5 is not;
* the shape (runs of letters and digits) is soft evidence: the score is multiplied by 1 if
  seeds of the kind have the candidate's shape, by ``SHAPE_ALIKE`` if they have it but for
  the lengths of runs of digits, by ``SHAPE_UNSEEN`` otherwise.

After ``ROUNDS`` rounds the candidates scored ``ACCEPT`` or more become spans.

Positions are code points, found by adding up the lengths of the pieces between matches.
Matching is linear: quantifiers are possessive, and a match can only begin where a run
of its characters does or where the last match ended.

The text is read twice, once for matches and once for word counts; only words with their
counts and the identifiers themselves are shuffled. Word counts have a map-side part, and
joins on a pattern's word have one row per word on the other side, so frequent words are
split by Spark.

Defined cases: NULL text is the empty text, without spans; rows with the same doc_id are
reported separately; an empty table gives an empty result; equal spans found twice are
reported once; ties in order go by start, then kind, then end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_TOKEN = r"[^\s\"'(),;:<>\[\]{}|\p{Pi}\p{Pf}　-〿！-／：-？]"
#: The base expressions, with possessive quantifiers and bounded starts.
EXPRESSIONS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the expression to match anywhere.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_GAP = r"[\x20()./-]"
_SYMBOL = _TOKEN.replace("^", r"^\p{L}\p{M}\p{N}")
_END = rf"(?={_SYMBOL}*+(?!{_TOKEN}))"
_TIGHT = r"(?:[./-]{1,3}+[0-9]++)"
_MORE = rf"(?:[./-]?+[\x20()]{_GAP}{{0,2}}+[0-9]++{_TIGHT}*+{_END})"
#: Candidates of several groups of digits, and tokens that are more than letters.
RUN = (
    rf"(?<!{_TOKEN})[+(]*+(?:[0-9]++{_TIGHT}++{_END}{_MORE}*+|[0-9]++{_END}{_MORE}++)"
    r"|(?<![\p{L}\p{N}:])[0-9A-Fa-f]{1,4}+(?::{1,2}+[0-9A-Fa-f]{1,4}+){2,}+(?![\p{L}\p{N}])"
)
TOKEN = (
    rf"(?<!{_TOKEN})(?!{_SYMBOL}*+[\p{{L}}\p{{M}}]*+{_SYMBOL}*+(?!{_TOKEN}))"
    rf"{_TOKEN}*[\p{{L}}\p{{M}}\p{{N}}]"
)
CONTEXT_CHARS = 64
ROUNDS = 3
MIN_SUPPORT = 3
ACCEPT = 0.5
SHAPE_ALIKE = 0.8
SHAPE_UNSEEN = 0.55
_BLOCK = 256


def _ends(sizes: Column) -> Column:
    """Running sums of an array of numbers; blocks keep long arrays near linear."""
    add = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    zero = F.lit(0).cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / F.lit(_BLOCK)).cast("int")),
        lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda s, x: s + x))
    begins = F.aggregate(totals, F.array(zero), add)
    inside = F.transform(
        blocks,
        lambda block, i: F.slice(
            F.aggregate(block, F.array(F.get(begins, i)), add), F.lit(2), F.lit(_BLOCK)
        ),
    )
    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(inside))


def _left_word(piece: Column) -> Column:
    near = F.substring(piece, -CONTEXT_CHARS, CONTEXT_CHARS)
    return F.lower(F.regexp_extract(near, r"(\p{L}+)\P{L}*$", 1))


def _right_word(piece: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring(piece, 1, CONTEXT_CHARS), r"\p{L}+", 0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def digit(total: Column, i: Column) -> Column:
        value = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(value > 4, 2 * value - 9).otherwise(2 * value)
        return total + F.when(i % 2 == 0, twice).otherwise(value)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), digit) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        small = lambda part: (F.length(part) <= 3) & (
            F.coalesce(part.try_cast("int"), F.lit(0)) <= 255
        )
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, small)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _with_matches(df: DataFrame, name: str, expression: str, needs: Column, kind: int, keep):
    """Adds ``name``: an array of (start, kind, end, value, left, right)."""
    none = F.array().cast("array<string>")
    pieces, values = f"__{name}_pieces", f"__{name}_values"
    df = df.withColumns(
        {
            pieces: F.when(needs, F.split("text", expression, -1)).otherwise(none),
            values: F.when(
                needs, F.regexp_extract_all("text", F.lit(expression), F.lit(0))
            ).otherwise(none),
        }
    )
    sizes = F.zip_with(
        F.slice(F.col(pieces), F.lit(1), F.size(values)),
        F.col(values),
        lambda piece, value: (F.length(piece) + F.length(value)).cast("long"),
    )
    df = df.withColumn(f"__{name}_ends", _ends(sizes))

    def span(value: Column, i: Column) -> Column:
        end = F.get(f"__{name}_ends", i)
        return F.struct(
            (end - F.length(value)).alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            value.alias("value"),
            _left_word(F.get(pieces, i)).alias("left"),
            _right_word(F.get(pieces, i + 1)).alias("right"),
        )

    spans = F.filter(F.transform(F.col(values), span), lambda s: keep(s["value"]))
    return df.withColumn(name, spans).drop(pieces, values, f"__{name}_ends")


def matched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, candidates): spans of the expressions, and candidate tokens."""
    df = docs.select("doc_id", text_of().alias("text"))
    for number, kind in enumerate(KINDS):
        needs = F.col("text").contains("@") if kind == "email" else F.col("text").rlike(NEEDS[kind])
        df = _with_matches(
            df, kind, EXPRESSIONS[kind], needs, number, lambda v, kind=kind: _valid(kind, v)
        )
    some, every = F.col("text").rlike("[0-9:]"), F.lit(True)
    df = _with_matches(df, "runs", RUN, some, -1, lambda v: F.lit(True))
    df = _with_matches(df, "tokens", TOKEN, every, -2, lambda v: F.lit(True))
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.concat(*KINDS).alias("base"),
        F.concat("runs", "tokens").alias("candidates"),
    )


def _alone(found: DataFrame) -> DataFrame:
    """Every span, every run that overlaps no span, every token that overlaps neither."""
    spans = found.select("row", F.explode(F.concat("base", "candidates")).alias("s")).select(
        "row", "s.*"
    )
    return _clear(_clear(spans, 0), -1)


def _clear(spans: DataFrame, least: int) -> DataFrame:
    """Rows of kind ``least`` or more, and the others that overlap none of them.

    Overlap is seen from the furthest end of a span before and the nearest start after.
    """
    held = F.col("kind") >= least
    by = Window.partitionBy("row").orderBy("start", F.col("kind").desc())
    before = F.max(F.when(held, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(held, F.col("start"))).over(
        Window.partitionBy("row").orderBy(F.col("start").desc(), "kind").rowsBetween(
            Window.unboundedPreceding, 0
        )
    )
    free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (
        F.coalesce("after", F.col("end")) >= F.col("end")
    )
    return (
        spans.withColumn("before", before)
        .withColumn("after", after)
        .filter(held | free)
        .drop("before", "after")
    )


def _shape(value: Column) -> Column:
    letters = F.regexp_replace(F.lower(value), r"\p{L}+", "a")
    return F.regexp_replace(letters, "[0-9]", "9")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, total) of the lower-cased letter runs of all texts."""
    words = F.explode(F.split(F.lower(text_of()), r"\P{L}+"))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("total"))


def _edges(occurrences: DataFrame) -> DataFrame:
    """(kind, instance, shape, side, word, n): how often an instance stands beside a word."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("left").alias("side"), F.col("left").alias("word")),
            F.struct(F.lit("right").alias("side"), F.col("right").alias("word")),
        )
    )
    instance = F.lower("value")
    return (
        occurrences.select(F.greatest("kind", F.lit(-1)).alias("kind"), instance.alias("instance"), _shape(F.col("value")).alias("shape"), sides.alias("s"))
        .select("kind", "instance", "shape", "s.side", "s.word")
        .filter("word != ''")
        .groupBy("kind", "instance", "shape", "side", "word")
        .agg(F.count("*").alias("n"))
    )


def accepted_instances(
    edges: DataFrame,
    totals: DataFrame,
    rounds: int = ROUNDS,
    min_support: int = MIN_SUPPORT,
    accept: float = ACCEPT,
) -> DataFrame:
    """(instance, label, score): candidates the patterns vouch for, and their kind.

    ``edges`` has kind -1 for candidates; ``totals`` is (word, total).
    """
    seeds = edges.filter("kind >= 0")
    candidates = edges.filter("kind < 0")
    beside = candidates.groupBy("instance", "side").agg(F.sum("n").alias("beside"))
    lone = F.regexp_replace("shape", "9+", "9")
    same = seeds.groupBy("shape").agg(F.collect_set("kind").alias("same"))
    alike = seeds.groupBy(lone.alias("alike_shape")).agg(F.collect_set("kind").alias("alike"))
    has = lambda name, k: F.coalesce(F.array_contains(name, k), F.lit(False))
    fit = [
        F.when(has("same", k), 1.0).when(has("alike", k), SHAPE_ALIKE).otherwise(SHAPE_UNSEEN)
        for k in range(len(KINDS))
    ]
    open_edges = stored(
        candidates.join(beside, ["instance", "side"])
        .join(same, "shape", "left")
        .join(alike, lone == F.col("alike_shape"), "left")
        .select("instance", "side", "word", "n", "beside", F.array(*fit).alias("fit")),
        "pii-candidates",
    )
    known = stored(
        seeds.groupBy(F.col("kind").alias("label"), "side", "word").agg(
            F.sum("n").cast("double").alias("mass"), F.count("*").alias("support")
        ),
        "pii-seeds",
    )
    words = seeds.select("word").union(open_edges.select("word")).distinct()
    counted = stored(words.join(totals, "word"), "pii-totals")
    scores = None
    pattern = ["label", "side", "word"]
    for _ in range(rounds):
        mass = known
        if scores is not None:
            learnt = (
                open_edges.join(scores, "instance")
                .groupBy(*pattern)
                .agg(
                    F.sum(F.col("n") * F.col("score")).alias("mass"),
                    F.count_if(F.col("score") >= accept).alias("support"),
                )
            )
            mass = (
                known.unionByName(learnt)
                .groupBy(*pattern)
                .agg(F.sum("mass").alias("mass"), F.sum("support").alias("support"))
            )
        confident = (
            mass.filter(F.col("support") >= min_support)
            .join(counted, "word")
            .select(*pattern, F.least(F.col("mass") / F.col("total"), F.lit(1.0)).alias("trust"))
        )
        any_of = lambda p: 1.0 - F.exp(F.sum(F.log(F.greatest(1.0 - p, F.lit(1e-12)))))
        share = F.least(F.sum(F.col("n") * F.col("trust")) / F.max("trust") / F.first("beside"), F.lit(1.0))
        sides = (
            open_edges.join(confident, ["side", "word"])
            .groupBy("instance", "label", "side")
            .agg(
                any_of(F.col("trust")).alias("vouched"),
                share.alias("share"),
                F.first("fit").alias("fit"),
            )
        )
        size = F.greatest(F.length(F.regexp_replace("instance", r"[^\p{L}\p{N}]", "")), F.lit(1))
        scores = stored(
            sides.withColumn("side_score", F.col("vouched") * F.pow("share", 1.0 / size))
            .groupBy("instance", "label")
            .agg((any_of(F.col("side_score")) * F.get(F.first("fit"), F.col("label"))).alias("score")),
            "pii-scores",
        )
    best = F.max(F.struct("score", -F.col("label")))
    return (
        scores.filter(F.col("score") >= accept)
        .groupBy("instance")
        .agg(best.alias("best"))
        .select(
            "instance", (-F.col("best.col2")).alias("label"), F.col("best.score").alias("score")
        )
    )


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind, end, value), one row per document.

    ``base`` holds the expressions' spans, ``added`` those the patterns discovered.
    """
    found = stored(matched(docs), "pii-found")
    occurrences = stored(_alone(found), "pii-occurrences")
    edges = stored(_edges(occurrences), "pii-edges")
    accepted = accepted_instances(edges, word_counts(docs), **options)
    span = lambda kind: F.struct("start", kind.alias("kind"), "end", "value")
    added = (
        occurrences.filter("kind < 0")
        .withColumn("instance", F.lower("value"))
        .join(accepted, "instance")
        .groupBy("row")
        .agg(F.collect_list(span(F.col("label"))).alias("added"))
    )
    bare = lambda name: F.transform(
        name, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    )
    return found.join(added, "row", "left").select(
        "doc_id",
        F.array_sort(bare("base")).alias("base"),
        F.array_sort(F.coalesce("added", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>"))).alias("added"),
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span in order, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))))
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def count_of(spans: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")
