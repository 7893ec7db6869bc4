"""Personal data by fixed patterns and bootstrapped contexts (DataFrame operations only).

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern and checks.
These are the seeds.  The words before a seed are a lexical pattern; a token with digits after
the same words is a candidate, as are spaced groups of digits and names at a host.  On the graph
of patterns and distinct values, Spark scores in turn patterns, by the share of their values that
are known to be of one kind, and values, by the patterns they follow.  Values that reach
``CONFIDENT`` are found, and patterns with enough seeds or found values find more, until nothing
is added.

The patterns are written so that each run of characters is tried once, from its start: the
matches are those of the plain forms in ``BASE``, in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.llm.common import fresh
from docquarry.operators.steps import let
from docquarry.session import cut_lineage

# Kinds in the order of the result, and the plain form of each pattern.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: The same matches: an address may start after another ends, else at the start of its run; a
#: card is a whole run of 13 to 19 digits.  Repeated groups are possessive: nothing that follows
#: could make them give back, and otherwise Java keeps a frame of its stack for each repetition.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A candidate: a run of at least six such characters with four digits in it.
_CANDIDATE = r"(?<![A-Za-z0-9._%+@/-])(?=(?:[A-Za-z._%+@/-]*+[0-9]){4})[A-Za-z0-9._%+@/-]{6,}+"
#: More candidates, which hold what the above doesn't: groups of digits, with blanks or brackets
#: among the marks between them, and a name at a host without a dot.
_GROUPS = r"(?<![A-Za-z0-9._%+@/()-])(?<![0-9][ ])[+(]{0,2}[0-9]++(?:[ ().-]{1,3}[0-9]++){1,18}+(?![A-Za-z0-9_%@/]|[ ().-]{1,3}[0-9])"
_AT_HOST = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![.@]?[A-Za-z0-9-])"
#: Code points before a hit that its context is taken from.
_REACH = 80

#: Score from which a value counts as found; distinct seeds or found values that a pattern needs;
#: rounds at least.  Rounds go on until nothing is found and all scores together rise no more than so.
CONFIDENT = 0.8
SUPPORT = 4
ROUNDS = 2
SETTLED = 0.01

#: Matches whose positions are added up at a time.
_AT_ONCE = 256
_HITS = "array<struct<start:int,stop:int,value:string,left:string>>"


def hits(text: Column, pattern: str, needs: str) -> Column:
    """All matches with start and end in code points, and what stands before them.

    ``needs`` is a string without which there is no match, so most texts skip the work.
    """
    found = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda before, value: F.struct(before.alias("before"), value.alias("value"))
    )

    # Positions add up within blocks of matches first and then over blocks, so that a text with
    # very many matches doesn't copy its list once for each of them.
    def in_order(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(_AT_ONCE))
        parts = F.transform(starts, lambda i: _placed(F.slice(whole, i + 1, _AT_ONCE)))
        joined = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_HITS}>").alias("parts")),
            lambda acc, p: F.struct(
                (acc["at"] + p["at"]).alias("at"), F.concat(acc["parts"], F.array(_moved(p["hits"], acc["at"]))).alias("parts")
            ),
        )
        return F.flatten(joined["parts"])

    placed = let(F.filter(found, lambda x: x["value"].isNotNull()), in_order)
    return F.when(text.rlike(needs), placed).otherwise(F.array().cast(_HITS))


def _moved(hits: Column, by: Column) -> Column:
    return F.transform(
        hits,
        lambda x: F.struct(
            (x["start"] + by).alias("start"), (x["stop"] + by).alias("stop"), x["value"].alias("value"), x["left"].alias("left")
        ),
    )


def _placed(found: Column) -> Column:
    """(at, hits) of matches in a row: their positions from the first piece on, and the whole length."""
    return F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.array().cast(_HITS).alias("hits")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["before"]) + F.char_length(x["value"])).alias("at"),
            F.concat(
                acc["hits"],
                F.array(
                    F.struct(
                        (acc["at"] + F.char_length(x["before"])).alias("start"),
                        (acc["at"] + F.char_length(x["before"]) + F.char_length(x["value"])).alias("stop"),
                        x["value"].alias("value"),
                        F.substring(x["before"], -_REACH, _REACH).alias("left"),
                    )
                ),
            ).alias("hits"),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = F.reverse(F.split(_digits(value), ""))
    doubled = F.transform(
        F.filter(digits, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, stop, value, left>> by kind, then start."""
    checks = {
        "email": (_EMAIL, "@", lambda v: F.lit(True)),
        "ip": (_IP, r"\.[0-9]", lambda v: F.forall(F.split(v, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))),
        "card": (_CARD, "[0-9]", luhn),
        "phone": (_PHONE, r"\+[0-9]", lambda v: F.char_length(_digits(v)).between(9, 15)),
    }
    parts = []
    for i, kind in enumerate(KINDS):
        parts.append(_of_kind(i, hits(text, *checks[kind][:2]), checks[kind][2]))
    return F.concat(*parts)


def _of_kind(number: int, found: Column, check) -> Column:
    good = F.filter(found, lambda x: check(x["value"]))
    return F.transform(
        good,
        lambda x: F.struct(
            F.lit(number).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), x["left"].alias("left")
        ),
    )


def _contexts(left: Column) -> Column:
    """The last word, and the last two, before a hit: lower case, digits as 0."""
    plain = F.regexp_replace(F.lower(left), "[0-9]", "0")
    one, two = (F.regexp_replace(F.regexp_extract(plain, p, 1), r"\s+", " ") for p in (r"(\S+)\s*$", r"(\S+\s+\S+)\s*$"))
    return F.filter(F.array_distinct(F.array(one, two)), lambda c: c != "")


def learn_values(mentions: DataFrame) -> DataFrame:
    """(value, kind) of candidates that high-confidence patterns find.

    ``mentions``: value, kind (null: a candidate) and contexts.  Copies of a passage count once,
    since scores are over distinct (pattern, value) pairs.
    """
    edges = mentions.select(F.explode("contexts").alias("pattern"), "value", "kind").distinct()
    # A pattern with fewer values than it needs known ones, or none to find, can't ever add anything.
    useful = (
        edges.groupBy("pattern")
        .agg(F.count_distinct("value").alias("values"), F.count_if(F.col("kind").isNull()).alias("open"))
        .filter((F.col("values") >= SUPPORT) & (F.col("open") > 0))
        .select("pattern", "values")
    )
    values = cut_lineage(useful, "pii-patterns")
    edges = cut_lineage(edges.join(values.select("pattern"), "pattern"), "pii-graph")
    # A value that is a seed somewhere is a seed everywhere.
    seeds = cut_lineage(edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct(), "pii-seeds")
    pairs = cut_lineage(edges.select("pattern", "value").distinct(), "pii-pairs")
    open_ = cut_lineage(pairs.join(seeds.select("value").distinct(), "value", "left_anti"), "pii-open")
    scores, learnt, before, rounds = seeds, None, (0, 0.0), 0
    while True:
        known = (
            pairs.join(scores, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("score"), F.count_if(F.col("score") >= CONFIDENT).alias("support"))
            .filter(F.col("support") >= SUPPORT)
        )
        trust = known.join(values, "pattern").select("pattern", "kind", (F.col("score") / (F.col("values") + 1)).alias("trust"))
        trust = cut_lineage(trust, "pii-trust")
        # noisy or: a value is of a kind unless all its patterns are wrong
        learnt = open_.join(trust, "pattern").groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score")
        )
        learnt = cut_lineage(learnt, "pii-scores")
        scores = seeds.unionByName(learnt)
        rounds += 1
        # Scores only rise from round to round, so it ends.
        after = learnt.agg(F.count_if(F.col("score") >= CONFIDENT), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if rounds >= ROUNDS and after[0] == before[0] and after[1] - before[1] <= SETTLED:
            break
        before = tuple(after)
    best = learnt.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
    return best.filter(F.col("score") >= CONFIDENT).select("value", "kind")


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, base, spans (arrays of kind number, start, stop).

    Starts and stops are code points, stops exclusive.  ``base`` holds the matches of the fixed
    patterns, ``spans`` these and what the contexts add, both by kind, then start.  Null texts
    count as empty; rows that repeat an id and a text have the same spans; an empty table gives
    none.
    """
    slim, added = _found_and_added(docs, doc_id, text)
    plain = _plain(F.col("found"))
    joined = slim.join(added, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("text_key") == F.col("__key")), "left")
    return joined.select(
        F.col("__id").alias(doc_id),
        "text_key",
        plain.alias("base"),
        F.when(F.col("added").isNull(), plain).otherwise(F.sort_array(F.concat(plain, "added"))).alias("spans"),
    )


def mask_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each span of :func:`personal_spans` in ``text`` replaced by its kind in brackets.

    The base spans are found again where the text is, so texts needn't meet them in a shuffle;
    only documents with added spans have something to be joined with.  Null texts stay null.
    """
    _, added = _found_and_added(docs, doc_id, text)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = fresh(docs, "__text_key")
    joined = docs.withColumn(key, F.xxhash64(body)).join(
        added, F.col(f"`{doc_id}`").eqNullSafe(F.col("__of")) & (F.col(key) == F.col("__key")), "left"
    )
    spans = F.concat(_plain(base_spans(body)), F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,stop:int>>")))
    masked = let(spans, lambda s: mask(F.col(f"`{text}`"), s))
    return joined.select(*[masked.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _plain(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))


def _found_and_added(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(__id, text_key, found, tokens) of all documents, and (__of, __key, added) of those with more."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.xxhash64(body).alias("text_key"), body.alias("__text"))
    seen = rows.select("__id", "text_key", base_spans(F.col("__text")).alias("found"), _candidates(F.col("__text")).alias("tokens"))
    apart = F.filter("tokens", lambda t: ~F.exists(F.col("found"), lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    slim = cut_lineage(seen.select("__id", "text_key", "found", apart.alias("tokens")), "pii-found")
    base = slim.select(F.explode("found").alias("x")).select("x.value", "x.kind", _contexts(F.col("x.left")).alias("contexts"))
    tokens = slim.select("__id", "text_key", F.explode("tokens").alias("x"))
    open_ = tokens.select("x.value", F.lit(None).cast("int").alias("kind"), _contexts(F.col("x.left")).alias("contexts"))
    learnt = cut_lineage(learn_values(base.unionByName(open_)), "pii-learnt")
    added = (
        tokens.select("__id", "text_key", "x.start", "x.stop", "x.value")
        .join(learnt, "value")
        .groupBy(F.col("__id").alias("__of"), F.col("text_key").alias("__key"))
        .agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
    )
    return slim, cut_lineage(added, "pii-added")


def _candidates(text: Column) -> Column:
    """Hits that may be personal data after words that say so."""
    digits = F.filter(
        hits(text, _GROUPS, r"[0-9][ ().-]+[0-9]"), lambda x: x["value"].rlike("[ ()]") & F.char_length(_digits(x["value"])).between(7, 19)
    )
    hosts = F.filter(hits(text, _AT_HOST, "@"), lambda x: ~x["value"].rlike(f"^(?:{_CANDIDATE})$"))
    return F.concat(hits(text, _CANDIDATE, "[0-9]"), digits, hosts)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    )


#: Code points of a piece that a text is cut into before it is masked.
_PIECE = 4096


def mask(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets.

    In time linear in text and spans: the text is cut into pieces once, in which the places
    between spans are found without counting from the start, and spans that overlap are merged
    in groups, so that no long list or text is copied once a span.
    """
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}+"), F.lit(0))

    def between(whole: Column, start: Column, stop: Column) -> Column:
        first, last = F.floor(start / _PIECE).cast("int"), F.floor(stop / _PIECE).cast("int")
        head, tail = F.coalesce(F.get(whole, first), F.lit("")), F.coalesce(F.get(whole, last), F.lit(""))
        inner = F.when(last > first + 1, F.array_join(F.slice(whole, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
        over = F.concat(F.substr(head, start % _PIECE + 1, F.lit(_PIECE)), inner, F.substr(tail, F.lit(1), stop % _PIECE))
        return F.when(first == last, F.substr(head, start % _PIECE + 1, stop - start)).otherwise(over)

    def filled(whole: Column) -> Column:
        return let(_gaps(ordered), lambda done: F.concat(
            F.array_join(F.transform(done["gaps"], lambda g: F.concat(between(whole, g["start"], g["stop"]), F.get(names, g["kind"]))), ""),
            between(whole, done["at"], F.char_length(text)),
        ))

    return F.when(F.size(spans) == 0, text).otherwise(let(pieces, filled))


_GAPS = "array<struct<start:int,stop:int,kind:int>>"


def _gaps(ordered: Column) -> Column:
    """(at, gaps): what stands before each span that begins outside all earlier ones, and their end."""

    def one(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), s["start"].alias("stop"), s["kind"].alias("kind"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), more.alias("gaps"))

    def group(acc: Column, i: Column, whole: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(_GAPS).alias("gaps"))
        done = F.aggregate(F.slice(whole, i + 1, _AT_ONCE), start, one)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["parts"], F.array(d["gaps"])).alias("parts")))

    def all_of(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(_AT_ONCE))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_GAPS}>").alias("parts"))
        return F.aggregate(starts, first, lambda acc, i: group(acc, i, whole))

    return let(let(ordered, all_of), lambda d: F.struct(d["at"].alias("at"), F.flatten(d["parts"]).alias("gaps")))
