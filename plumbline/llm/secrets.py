"""Secret scans: fixed patterns, and Markov models of characters.

Two first-order Markov models of characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples by counting pairs of
characters. A run of token characters is a secret where the log-likelihood
ratio of the two is high enough, in all and for each pair; where that of the
whole run is not, its best-scoring stretches are looked for, so that ordinary
text joined to a secret does not hide it. Everything is made of built-in
functions: matches give the text between them by ``split``, and lengths of
both give positions in code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: Fixed patterns, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

KINDS = ["assign", "access", "hex", "markov"]
#: Characters that the models know; a run of others ends a candidate.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE_LENGTH = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}"
#: Least log-likelihood ratio in nats, in all and for each pair of characters.
LEAST_TOTAL, LEAST_EACH = 12.0, 0.5
#: Labelled samples of each kind that the default models are trained from.
SAMPLES = 10_000

#: Parts that sample identifiers are put together from.
PARTS = (
    "get set user name id count index value table column file path read write load save open close list map key item node edge "
    "request response handler service manager config option default error message event start stop begin end update delete "
    "insert select create build parse format encode decode buffer stream queue thread process task job worker session page "
    "the and that with from this thing tion tions ing ings ation ment ments ness able ible ance ence ent ant ity ive ous ful "
    "less er ers or est ed ly en re un in an on at es is it he ha th wh sh ch st nd nt ea ou ee ble com pro con dis inter "
    "ein eine und der die das ist nicht mit von den dem auf ung ungen keit keiten heit lich lichen isch schaft sch ver be ge "
    "zer ent auch sich zu bei nach aus vor chen tz pf ach au eu ie ei "
    "le la les de des du un une et est que qui dans pour sur avec pas eau eaux elle elles eux ment aire tion oi ai ier re en par "
    "el los las una por con para como cion mente ado ada idad ar ir os as lla que se su de co bo "
    "abstract singleton proxy factory bean implementation controller repository component context provider adapter builder template "
    "prze nia nie owa ego ych sze rzy czy dzie wie wy sta ost ova eni pro pod nych sci ow ki "
    "zione gli delle ij heid lijk sch een van het aan llan gwyn pwll gog goch wyll dro ty sil gor mor fer ynys"
).split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(value, random): n random strings and n ordinary identifiers, made by rule."""
    parts = F.array(*[F.lit(p) for p in PARTS])
    draw = lambda *k: F.pmod(F.xxhash64("id", *map(F.lit, k)), F.lit(len(PARTS))).cast("int")
    pick = lambda k: parts[draw(k)]
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(10**9)).cast("string")
    words = [pick(k) for k in range(6)]
    ids = spark.range(n)
    ordinary = F.element_at(
        F.array(
            F.concat(*words),
            F.concat(*words[:3]),
            F.concat(F.initcap(words[0]), *words[1:5]),
            F.concat_ws("_", *words[:4]),
            F.concat_ws("-", *words[:5]),
            F.concat_ws("/", *words),
            F.concat(words[0], *[F.initcap(w) for w in words[1:4]]),
            F.upper(F.concat_ws("_", *words[:3])),
            F.upper(F.concat(*words[:5])),
            F.concat_ws("_", words[0], words[1], F.substring(number, 1, 4)),
            F.concat_ws("=", words[0], F.concat(words[1], words[2])),
            F.concat(number, F.reverse(number)),
            F.repeat(F.substring(F.lit(ALPHABET), F.pmod("id", F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1)), F.lit(24)),
            # Identifiers of records, whose digits are hexadecimal but in known groups.
            F.concat_ws("-", *[F.substring(F.md5(F.concat(F.lit("uuid"), F.col("id").cast("string"))), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
            F.concat(*[F.initcap(w) for w in words]),
            # Sequences of bases.
            F.translate(F.sha2(F.concat(F.lit("bases"), F.col("id").cast("string")), 256), "0123456789abcdef", "ACGTACGTACGTACGT"),
        ),
        (F.pmod("id", F.lit(16)) + 1).cast("int"),
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = F.element_at(
        F.array(
            digest,
            F.translate(F.base64(F.unhex(digest)), "=\r\n", ""),
            F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""),
            F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")),
        ),
        (F.pmod("id", F.lit(4)) + 1).cast("int"),
    )
    return ids.select(ordinary.alias("value"), F.lit(False).alias("random")).union(ids.select(random.alias("value"), F.lit(True).alias("random")))


def _code(char: Column) -> Column:
    return F.instr(F.lit(ALPHABET), char) - 1


def _place(text: Column, i: Column) -> Column:
    """The number of the pair of characters of text that begins at i (from 1)."""
    return _code(F.substring(text, i, F.lit(1))) * len(ALPHABET) + _code(F.substring(text, i + 1, F.lit(1)))


def train(labelled: DataFrame) -> list[float]:
    """labelled(value, random) -> log-likelihood ratio of each pair of characters.

    Null values, labels and characters outside the alphabet are passed over;
    without samples of a kind its model is uniform. Counts are of at most the
    alphabet's size squared for each label.
    """
    size = len(ALPHABET)
    runs = labelled.dropna().select("random", F.explode(F.regexp_extract_all("value", F.lit(r"([A-Za-z0-9+/_=-]{2,})"), 1)).alias("v"))
    at = runs.select("random", "v", F.explode(F.sequence(F.lit(1), F.length("v") - 1)).alias("i"))
    counted = at.groupBy("random", _place(F.col("v"), F.col("i")).alias("pair")).count().collect()
    counts = {False: [1.0] * size * size, True: [1.0] * size * size}
    for r in counted:
        counts[r["random"]][r["pair"]] += r["count"]
    log = {}
    for kind, c in counts.items():
        rows = [sum(c[k * size : (k + 1) * size]) for k in range(size)]
        log[kind] = [math.log(c[k] / rows[k // size]) for k in range(size * size)]
    return [a - b for a, b in zip(log[True], log[False], strict=True)]


#: Spans that a walk gathers before it adds them to what it has, so that its work does not grow as their number's square.
CHUNK = 128


def _chunks(xs: Column) -> Column:
    """The elements of an array that is not empty, CHUNK of them at a time."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / CHUNK).cast("int") - 1), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))


def _walk(xs: Column, kind: str, step: Callable[[Column, Column, Column, Column], Column], within: Callable[[Column, Column], Column] | None = None) -> Column:
    """(at, out) after step(at, out, x, within(at, chunk)) -> (at, out) for each element of an array that is not empty."""
    none = F.array().cast(f"array<{kind}>")

    def chunk(state: Column, part: Column) -> Column:
        start = F.struct(state["at"].alias("at"), none.alias("out"))
        walked = lambda w: F.aggregate(part, start, lambda s, x: step(s["at"], s["out"], x, w))
        inner = walked(None) if within is None else _let(within(state["at"], part), walked)
        return _let(inner, lambda got: F.struct(got["at"].alias("at"), F.concat(state["out"], F.array(got["out"])).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return _let(xs, lambda x: F.aggregate(_chunks(x), first, chunk))


def _spans(text: Column, pattern: str, kind: int, matches: Column) -> Column:
    """(start, kind, end, match) of each match, in order."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    shape = "struct<start:int,kind:int,end:int,value:string>"

    def step(at: Column, out: Column, x: Column, _: Column) -> Column:
        start = at + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(out, F.array(span)).alias("out"))

    walked = _walk(F.arrays_zip(gaps.alias("gap"), matches.alias("m")), shape, step)
    return F.when(F.size(matches) > 0, F.flatten(walked["out"])).otherwise(F.array().cast(f"array<{shape}>"))


def _replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """text with fill(span, end of those before it) in place of each span; they are in order and may overlap."""

    def step(at: Column, out: Column, s: Column, w: Column) -> Column:
        gap = F.when(s["start"] > at, F.substring(w["text"], at - w["from"] + 1, s["start"] - at)).otherwise("")
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.concat(out, F.array(gap, fill(s, at))).alias("out"))

    def within(at: Column, part: Column) -> Column:
        until = F.element_at(part, -1)["start"]
        return F.struct(at.alias("from"), F.substring(text, at + 1, F.greatest(until - at, F.lit(0))).alias("text"))

    done = _let(_walk(spans, "string", step, within), lambda s: F.concat(F.array_join(F.flatten(s["out"]), ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _stretches(piece: Column, table: Column) -> Column:
    """Spans of a piece that the models take for random: all of it where its average is high enough, or else its best stretches.

    A stretch has CANDIDATE_LENGTH characters at least and the greatest sum of
    what its pairs have over LEAST_EACH. It ends where LEAST_TOTAL is lost
    again, after which the next is looked for. Letters and digits next to a
    stretch belong to it.
    """
    value, short, letters = piece["value"], CANDIDATE_LENGTH - 1, 62
    none = F.array().cast("array<struct<start:int,end:int>>")
    enough = lambda over, n: (over >= 0) & (over + LEAST_EACH * n >= LEAST_TOTAL)

    def whole(s: Column, breaks: Column) -> Column:
        """The best stretch with the letters and digits next to it, up to the breaks that are counted before its begin and its end."""
        start = F.when(s["first_breaks"] == 0, 0).otherwise(F.element_at(breaks, F.greatest(s["first_breaks"], F.lit(1))) + 1)
        end = F.when(s["last_breaks"] == F.size(breaks), F.length(value)).otherwise(F.element_at(breaks, F.least(s["last_breaks"] + 1, F.greatest(F.size(breaks), F.lit(1)))))
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    def joined_to(out: Column, x: Column) -> Column:
        """Stretches so far with one more, which joins the one before if they meet."""
        last = F.try_element_at(out, F.lit(-1))
        meets = (F.size(out) > 0) & (F.coalesce(last["end"], F.lit(-1)) >= x["start"])
        both = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        return F.when(meets, both).otherwise(F.concat(out, F.array(x)))

    def found(x: Column, c: Column, breaks: Column) -> Column:
        n = F.size(x)
        # Codes beyond letters and digits are breaks; element_at counts from 1.
        broken = lambda i: (F.element_at(c, F.greatest(i, F.lit(1))) >= letters).cast("int")

        def step(both: Column, i: Column) -> Column:
            # What a step found is added by the next one: a list that went through the steps below would be copied in each.
            s = both["at"]

            def best(t: Column) -> Column:
                up = t["sum"] - t["low"] > t["best"]
                keep = lambda new, name: F.when(up, new).otherwise(t[name]).alias(name)
                moved = F.struct(
                    *[t[k].alias(k) for k in ("sum", "back", "low", "at", "least", "at_breaks", "back_breaks", "breaks")],
                    keep(t["sum"] - t["low"], "best"), keep(t["at"], "first"), keep(i, "last"), keep(t["sum"], "top"), keep(t["at_breaks"], "first_breaks"), keep(t["breaks"], "last_breaks"), F.lit(False).alias("closing"), t["stretch"].alias("stretch"),
                )
                return _let(moved, close)

            def close(t: Column) -> Column:
                over = enough(t["best"], t["last"] - t["first"]) & (t["top"] - t["sum"] >= LEAST_TOTAL)
                return F.when(over, state(t["sum"], t["back"], t["last"], t["back_breaks"], t["breaks"], F.lit(True), whole(t, breaks))).otherwise(t)

            at = i - short
            total, back = s["sum"] + F.element_at(x, i), s["back"] + F.when(at > 0, F.element_at(x, F.greatest(at, F.lit(1)))).otherwise(0.0)
            lower = (at >= s["least"]) & (back < s["low"])
            # Breaks before place ``at``, and before the end of pair i.
            back_breaks, before = s["back_breaks"] + F.when(at > 0, broken(at)).otherwise(0), s["breaks"] + broken(i + 1)
            t = F.struct(
                total.alias("sum"), back.alias("back"), F.when(lower, back).otherwise(s["low"]).alias("low"), F.when(lower, at).otherwise(s["at"]).alias("at"), s["least"].alias("least"),
                F.when(lower, back_breaks).otherwise(s["at_breaks"]).alias("at_breaks"), back_breaks.alias("back_breaks"), before.alias("breaks"),
                *[s[k].alias(k) for k in ("best", "first", "last", "top", "first_breaks", "last_breaks", "stretch")],
            )
            return F.struct(_let(t, best).alias("at"), added(both).alias("out"))

        def added(both: Column) -> Column:
            return F.when(both["at"]["closing"], joined_to(both["out"], both["at"]["stretch"])).otherwise(both["out"])

        def finish(both: Column) -> Column:
            s, every = both["at"], F.array(F.struct(F.lit(0).alias("start"), F.length(value).alias("end")))
            last = _let(added(both), lambda out: F.when(enough(s["best"], s["last"] - s["first"]), joined_to(out, whole(s, breaks))).otherwise(out))
            return F.when(enough(s["sum"], n), every).otherwise(last)

        nowhere = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
        begin = state(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), broken(F.lit(1)), F.lit(False), nowhere)
        return F.aggregate(F.sequence(F.lit(1), n), F.struct(begin.alias("at"), none.alias("out")), step, finish)

    def state(total: Column, back: Column, least: Column, back_breaks: Column, before: Column, closing: Column, stretch: Column) -> Column:
        # Sums of what pairs have over LEAST_EACH: of all pairs, and of those CANDIDATE_LENGTH - 1 back, whose least at or after ``least`` begins the stretch.
        return F.struct(
            total.alias("sum"), back.alias("back"), F.lit(1e300).alias("low"), F.lit(0).alias("at"), least.alias("least"), F.lit(0).alias("at_breaks"), back_breaks.alias("back_breaks"), before.alias("breaks"),
            F.lit(-1e300).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0.0).alias("top"), F.lit(0).alias("first_breaks"), F.lit(0).alias("last_breaks"), closing.alias("closing"), stretch.alias("stretch"),
        )

    def spans(c: Column) -> Column:
        ratios = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.element_at(table, (F.element_at(c, i) * len(ALPHABET) + F.element_at(c, i + 1) + 1).cast("int")) - LEAST_EACH)
        breaks = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.element_at(c, i + 1) >= letters)
        got = _let(ratios, lambda x: _let(breaks, lambda b: found(x, c, b)))
        # A stretch's text from its codes: the run's own would be walked from its begin for each.
        text = lambda s: F.array_join(F.transform(F.sequence(s["start"] + 1, s["end"]), lambda k: F.substring(F.lit(ALPHABET), F.element_at(c, k) + 1, F.lit(1))), "")
        return F.transform(got, lambda s: F.struct((piece["start"] + s["start"]).alias("start"), F.lit(3).alias("kind"), (piece["start"] + s["end"]).alias("end"), text(s).alias("value")))

    return _let(F.transform(F.regexp_extract_all(value, F.lit("."), F.lit(0)), _code), spans)


def scan(docs: DataFrame, ratios: list[float] | None = None, text_col: str = "text", into: str = "__found") -> DataFrame:
    """docs with the column ``into``: (base, all), each an array of (start, kind, end, value).

    Spans are in order of start and then kind; start and end count code points,
    end exclusive. base holds those of the fixed patterns, leftmost and without
    overlap within a kind; all holds also what the models take for random in the
    parts of runs that base does not cover. Null and empty texts have none. Rows are
    neither dropped nor joined, so repeated rows and nulls in other columns
    stay as they are, and an empty table gives none; only ``into`` is added,
    in place of a column of that name. Work grows with a text's length, also
    where it is one run or has very many spans.
    """
    ratios = ratios or train(samples(docs.sparkSession))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    patterns = [ASSIGN, ACCESS, HEX.replace("+", f"{{{HEX_LENGTH},}}")]
    least = [
        lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE,
        lambda s: s["end"] - s["start"] >= ACCESS_LENGTH,
        lambda s: s["end"] - s["start"] >= HEX_LENGTH,
    ]
    # All columns in one, so that no name of docs clashes with those made here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.col("text")
    d = docs.select(row.alias("row"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    d = d.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(patterns)])
    d = d.select("row", "text", *[F.filter(_spans(text, p, k, F.col(f"m{k}")), f).alias(f"s{k}") for k, (p, f) in enumerate(zip(patterns, least, strict=True))])
    d = d.select("row", "text", F.array_sort(F.concat("s0", "s1", "s2")).alias("base"))
    # What base covers is no part of a run, which then has the same places as before.
    masked = _replaced(text, F.col("base"), lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))
    d = d.select("row", "base", masked.alias("masked"))
    d = d.select("*", F.regexp_extract_all("masked", F.lit(CANDIDATE), F.lit(0)).alias("m3"))
    d = d.select("row", "base", _spans(F.col("masked"), CANDIDATE, 3, F.col("m3")).alias("runs"))
    added = F.flatten(F.transform("runs", lambda p: _stretches(p, table)))
    every = F.when(F.size("runs") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base"))
    d = d.select("row", F.struct(F.col("base"), every.alias("all")).alias("__f"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != into]
    return d.select(*kept, F.col("__f").alias(into))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones as one, replaced by a mark."""
    return _replaced(text, spans, lambda s, at: F.when((s["start"] >= at), mark).otherwise(""))


def redact(docs: DataFrame, ratios: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text_col replaced by a mark; null texts stay null."""
    found = scan(docs, ratios, text_col)
    return found.withColumn(text_col, redacted(F.col(text_col), F.col("__found.all"))).drop("__found")
