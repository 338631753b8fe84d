"""Personal data by candidate generation and gradient-boosted trees.

High-recall generators propose spans that may overlap: every e-mail-like token,
every chain of digit groups, every run of neighbouring groups in a chain and every
dotted number. Strict format rules (valid parts, check digits, digit counts) mark
some of them as certain; these are always reported. A chain that fails its rule
may still be two values side by side, so its runs are candidates of their own. All
that no rule accepts or refuses are scored by boosted trees on format and context
features, learned from every candidate whose format is decisive: certain ones
against ones that fail their rule and digits amid letters. A quarter of these,
which the trees do not see, calibrates: per generator, the threshold is the lowest
score at which the whole quarter keeps the wanted precision. Candidates with equal
features are learned as one, with their number as weight. Of added spans that
overlap the best stays.

DataFrame functions and Spark's own tree learner only; nothing runs in Python on
the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle, text_of
from barloom.llm.spans import SPAN, Pattern, ordered, overlaps, with_matches, written

# The kinds and their expressions. A match that may only begin a run of its class, or follow a match, and
# possessive quantifiers change no match here and keep very long runs linear: what they take stops before what must follow.
PATTERNS = (
    Pattern("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", hint="@"),
    Pattern("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", hint="[0-9]"),
    Pattern("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", hint="[0-9]"),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", hint="+"),
    Pattern("address", r"(?:\G|(?<![^\s@<>,;]))(?:[^\s@<>,;(\[]++|[(\[](?!(?i:at)[)\]]))++(?:@|\x20?[(\[](?i:at)[)\]]\x20?)[^\s@<>,;]++", hint="@|[(\\[][aA][tT][)\\]]"),
    Pattern("number", r"(?:\G|(?<![0-9]))[+(]?[0-9](?:[\x20().,/:-]{0,2}[0-9]){6,}+", hint="[0-9]"),
)
BASE = ("email", "ip", "card", "phone")
MORE = ("address", "number")
CONTEXT = 24
# Digits of a run of groups, from the least of the `number` generator to the most of a card.
FEWEST_DIGITS, MOST_DIGITS = 7, 19
TREES = 10
DEPTH = 4
PRECISION = 0.98

FEATURES = ("long", "digits", "letters", "groups", "longest_group", "plus", "dots", "dashes", "spaces", "slashes", "parens", "colons",
            "at", "word_before", "colon_before", "letter_before", "letter_after", "digit_share", "cue", "luhn")

# Words that announce personal data.
CUES = "(?i)phone|tel|call|mobile|fax|mail|contact|card|iban|account|address|passport|ssn"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits' check sum is right: from the right, every second digit is doubled."""
    turned = F.reverse(_digits(value))

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.split(turned, ""), weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(value: Column) -> Column:
    """Whether each dotted part is at most 255, however many zeros lead it."""
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _amid_letters(c: Column) -> Column:
    """Whether a number has a letter on both sides, as the digits of a token or a key do."""
    return (c["s"]["kind"] == "number") & F.rlike(c["before"], F.lit("[A-Za-z]$")) & F.rlike(c["after"], F.lit("^[A-Za-z]"))


RULES = {
    "email": lambda v: F.lit(True),
    "ip": _small_parts,
    "card": lambda v: _between(F.length(_digits(v)), 14, 19) & _luhn(v),
    "phone": lambda v: _between(F.length(_digits(v)), 10, 15),
}


# The form of a whole value per kind that a run of groups can have.
FORMS = {"card": r"^[0-9](?:[\x20-]?[0-9]){13,}+$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$", "ip": r"^[0-9]++(?:\.[0-9]++){3}$"}


def _accepted(kind: str) -> Column:
    return F.filter(kind, lambda s: RULES[kind](s["value"]))


def _before(start: Column) -> Column:
    return F.substring(F.col("text"), F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))


def _after(end: Column) -> Column:
    return F.substring(F.col("text"), end + 1, F.lit(CONTEXT))


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _runs(chain: Column) -> Column:
    """Runs of neighbouring digit groups of a chain in ``text``, with an opening + or parenthesis; one that passes a rule has its kind.

    Each is a struct of the span ``s`` and its context, ``before`` and ``after``.
    """
    ranks = {p.kind: i for i, p in enumerate(PATTERNS)}
    rank_of = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])

    def step(state: Column, x: Column) -> Column:
        first, n = state["at"] + F.length(x["gap"]), F.length(x["digits"])
        start = first - F.rlike(x["gap"], F.lit("[+(]$")).cast("int")
        group = F.struct(start.alias("start"), (first + n).alias("end"), x["gap"].alias("gap"), x["digits"].alias("digits"),
                         state["count"].alias("fewer"), (state["count"] + n).alias("upto"), _before(start).alias("before"), _after(first + n).alias("after"))
        return F.struct((first + n).alias("at"), (state["count"] + n).alias("count"), F.concat(state["groups"], F.array(group)).alias("groups"))

    def grouped(digits: Column) -> Column:
        zipped = F.arrays_zip(F.slice(F.split(chain["value"], "[0-9]+", -1), F.lit(1), F.size(digits)).alias("gap"), digits.alias("digits"))
        empty = F.array().cast("array<struct<start:int,end:int,gap:string,digits:string,fewer:int,upto:int,before:string,after:string>>")
        return F.aggregate(zipped, F.struct(chain["start"].alias("at"), F.lit(0).alias("count"), empty.alias("groups")), step)["groups"]

    def run(near: Column, n: Column) -> Column:
        first, last = near[0], F.element_at(near, n)
        opening = F.regexp_extract(first["gap"], "[+(]$", 0)
        rest = F.transform(F.slice(near, F.lit(2), n - 1), lambda g: F.concat(g["gap"], g["digits"]))

        def spanned(value: Column) -> Column:
            kind = F.lit("number")
            for k, form in FORMS.items():
                kind = F.when(F.rlike(value, F.lit(form)) & RULES[k](value), k).otherwise(kind)
            return _with(kind, lambda k: F.struct(
                F.struct(first["start"].alias("start"), F.element_at(rank_of, k).alias("rank"), last["end"].alias("end"), k.alias("kind"),
                         value.alias("value")).alias("s"), first["before"].alias("before"), last["after"].alias("after")))

        return _with(F.concat(opening, first["digits"], F.array_join(rest, "")), spanned)

    def from_each(groups: Column) -> Column:
        def started(_, i: Column) -> Column:
            # A group has a digit at least, so no run has more groups than digits.
            return _with(F.slice(groups, i + 1, F.lit(MOST_DIGITS)), lambda near: F.transform(
                F.filter(F.sequence(F.lit(1), F.size(near)), lambda n: _between(
                    F.element_at(near, n)["upto"] - near[0]["fewer"], FEWEST_DIGITS, MOST_DIGITS)), lambda n: run(near, n)))

        return F.flatten(F.transform(groups, started))

    return _with(F.regexp_extract_all(chain["value"], F.lit("[0-9]+"), F.lit(0)), lambda digits: _with(grouped(digits), from_each))


def _described(c: DataFrame) -> DataFrame:
    """Format and context features of candidates (value, before, after)."""
    v, n = F.col("value"), F.length("value").cast("double")

    def many(chars: str) -> Column:
        return F.regexp_count(v, F.lit(chars)).cast("double")

    groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    return c.withColumns({
        "long": n, "digits": many("[0-9]"), "letters": many("[A-Za-z]"), "groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "plus": many(r"\+"), "dots": many(r"\."), "dashes": many("-"), "spaces": many(" "), "slashes": many("/"),
        "parens": many("[()]"), "colons": many(":"), "at": many("@"),
        "word_before": F.length(F.regexp_extract("before", r"([^\s]*)\s*$", 1)).cast("double"),
        "colon_before": F.rlike("before", F.lit(r"[:=]\s*$")).cast("double"),
        "letter_before": F.rlike("before", F.lit(r"[A-Za-z]$")).cast("double"),
        "letter_after": F.rlike("after", F.lit("^[A-Za-z]")).cast("double"),
        "digit_share": many("[0-9]") / F.greatest(n, F.lit(1.0)),
        "cue": F.rlike("before", F.lit(CUES)).cast("double"),
        "luhn": F.when(_between(many("[0-9]"), 14, MOST_DIGITS), _luhn(v)).otherwise(False).cast("double")})


def _vectors(described: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described)


def fit(candidates: DataFrame, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION):
    """The model and its threshold per generator, from every candidate with a decisive format.

    Without candidates of both kinds there is nothing to learn, and None comes back.
    """
    decisive = _described(candidates.where("sure IS NOT NULL")).select(
        *FEATURES, "kind", F.col("sure").cast("double").alias("label"), (F.pmod(F.xxhash64("start", "row"), F.lit(4)) == 0).alias("calibrates"))
    decided = settle(decisive.groupBy(*decisive.columns).agg(F.count(F.lit(1)).cast("double").alias("weight")), "candidates")
    kinds = {r["label"] for r in decided.where("NOT calibrates").select("label").distinct().collect()}
    if kinds != {0.0, 1.0}:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, checkpointInterval=-1, weightCol="weight").fit(_vectors(decided.where("NOT calibrates")))
    scored = _scored(model, decided.where("calibrates"))
    # Kinds times 100 score steps: a bounded table.
    steps = scored.groupBy("kind", F.floor(F.col("score") * 100).alias("step")).agg(
        F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("all")).orderBy("kind", F.desc("step")).collect()
    thresholds, right, every = {}, {}, {}
    for r in steps:
        k = r["kind"]
        right[k], every[k] = right.get(k, 0) + r["right"], every.get(k, 0) + r["all"]
        if right[k] >= precision * every[k]:
            thresholds[k] = r["step"] / 100
    return model, thresholds


def _scored(model, described: DataFrame) -> DataFrame:
    return model.transform(_vectors(described)).withColumn("score", vector_to_array("probability")[1])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more.

    ``spans`` has the certain spans and those that the trees add; an added span
    overlaps neither a certain one nor another added one. Null text counts as empty and has no spans.
    Repeated rows and ids are handled row by row; an empty table, or one without
    candidates of both kinds, adds nothing. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    found = with_matches(rows, PATTERNS)
    certain = {k: _accepted(k) for k in BASE}
    held = found.select("id", "text", *[certain[k].alias(k) for k in BASE], *MORE, *[F.col(k).alias(f"all_{k}") for k in ("ip", "card", "phone")])
    failed = F.concat(*[F.array_except(F.col(f"all_{k}"), F.col(k)) for k in ("ip", "card", "phone")])
    based = held.select("id", "text", F.monotonically_increasing_id().alias("row"), ordered(*[F.col(k) for k in BASE]).alias("base"),
                        failed.alias("failed"), F.concat(*MORE).alias("more"))
    # A number of up to MOST_DIGITS is a run of all its groups.
    chains = F.concat(F.filter("more", lambda s: s["kind"] == "number"), F.filter("failed", lambda f: ~F.exists(
        "more", lambda s: (s["kind"] == "number") & (s["start"] <= f["start"]) & (s["end"] >= f["end"]))))
    whole = F.filter("more", lambda s: (s["kind"] != "number") | (F.length(_digits(s["value"])) > MOST_DIGITS))
    def example(sure: int):
        return lambda s: F.struct(s.alias("s"), F.lit(sure).alias("sure"), F.lit(False).alias("open"), _before(s["start"]).alias("before"), _after(s["end"]).alias("after"))

    # sure: 1 for what a rule accepts, 0 for what it refuses, null for what no rule decides. Only digits amid letters are
    # an example of what is refused and are scored as well.
    undecided = F.concat(
        F.transform(whole, lambda s: F.struct(s.alias("s"), _before(s["start"]).alias("before"), _after(s["end"]).alias("after"))),
        F.flatten(F.transform(chains, _runs)))
    proposed = F.concat(
        F.transform("base", example(1)), F.transform("failed", example(0)),
        F.transform(_with(F.col("base"), lambda base: F.filter(undecided, lambda c: ~overlaps(base, c["s"]["start"], c["s"]["end"]))), lambda c: F.struct(
            c["s"].alias("s"), F.when(_amid_letters(c), 0).alias("sure"), F.lit(True).alias("open"), c["before"].alias("before"), c["after"].alias("after"))))
    scanned = settle(based.select("id", "row", "base", proposed.alias("proposed")), "scanned")
    candidates = scanned.select("row", F.explode("proposed").alias("c")).select("row", "c.s.*", "c.sure", "c.open", "c.before", "c.after")
    fitted = fit(candidates)
    if fitted is None or not fitted[1]:
        full = scanned.withColumn("added", F.array().cast(SPAN))
    else:
        model, thresholds = fitted
        # A generator without a rule of its own takes the strictest threshold of the rules its form resembles.
        limit = max(thresholds.values())
        chosen = _scored(model, _described(candidates.where("open"))).where(F.col("score") >= limit)
        # Best first: what passes a rule, then by score, then the longer one.
        span = F.struct("start", "rank", "end", "kind", "value")
        best = F.struct(F.col("kind").isin(*MORE).cast("int").alias("ruleless"), (-F.col("score")).alias("score"),
                        (F.col("start") - F.col("end")).alias("long"), span.alias("s"))
        kept = F.aggregate(F.array_sort(F.collect_list(best)), F.array().cast(SPAN), lambda a, c: F.when(
            overlaps(a, c["s"]["start"], c["s"]["end"]), a).otherwise(F.concat(F.array(c["s"]), a)))
        added = chosen.groupBy("row").agg(F.array_sort(kept).alias("added"))
        full = scanned.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return full.select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(ordered(F.col("base"), F.col("added"))).alias("spans"), F.size("added").cast("long").alias("n_more"))
