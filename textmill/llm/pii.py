"""Personal data in texts, by SQL expressions alone.

Base spans are those of fixed formats (email, ip, card, phone). Around them
generators with high recall propose more spans, which may overlap: obfuscated
addresses, phone numbers without a country code, cards in unusual groups, IPv6
and defanged addresses, and secrets (keys and tokens, a kind of their own).
Gradient-boosted trees score each proposal by its format and by the words before
it; a calibrated threshold for each kind selects, and of overlapping ones the
best stays. The trees are trained by ``pii_train`` and kept in
``pii_model.json``; here they are nested CASE expressions.

Work is in proportion to a text's length and its matches: arrays are gathered in
blocks, never one element at a time onto a growing one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that have base spans.
BASE = KINDS[:4]
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_MATCH = "struct<start:int,kind:int,end:int,m:string,b:string>"

# A match can only begin where the last one ended or where the run of its first
# class begins, and what follows a repeat is never in the repeat's class; so
# looking behind and possessive repeats change no match, but keep the search
# linear and off the stack in long runs.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Proposals: kind, a cheap test of the text, pattern. None is longer than ``LONGEST`` or shorter than ``SHORTEST``.
GENERATORS = (
    (0, r"(?i)[\[({<] ?at ?[\])}>]", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?at ?[\])}>] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({<] ?dot ?[\])}>]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    (0, r"(?i) at [A-Za-z0-9-]+ dot ", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4}"),
    (1, r"\[\.\]", r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])"),
    (1, r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    (1, r"[0-9A-Fa-f]::[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"),
    (2, r"[0-9]{4}[._/][0-9]{4}[._/][0-9]", r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9A-Za-z])"),
    (2, r"[0-9]{13}", r"(?<![0-9A-Za-z])[0-9]{13}(?![0-9A-Za-z])"),
    (3, r"[0-9][). -]{1,2}[0-9]{3,4}[ .-][0-9]", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])"),
    (4, r"[A-Za-z0-9_/+=-]{16}", r"(?<![A-Za-z0-9_/+=.@-])(?=[A-Za-z_/+=-]{0,200}[0-9])[A-Za-z0-9_/+=-]{16,200}(?![A-Za-z0-9_/+=@-])"),
)
LONGEST, SHORTEST = 400, 6
#: Proposals that can begin within ``LONGEST`` before or after another one: those of one generator do not overlap.
NEIGHBOURS = len(GENERATORS) * (LONGEST // SHORTEST + 1)

#: Words that announce a kind, looked for in the characters before a proposal.
CONTEXT = {
    0: r"(?i)mail|contact|write|kontakt|correo|courriel|e-?mail|reach|ask",
    1: r"(?i)\bip\b|addr|host|server|ping|client|login|from",
    2: r"(?i)card|visa|master|amex|karte|carte|tarjeta|pay|credit|iban",
    3: r"(?i)phone|tel|call|fax|mobile|cell|handy|anruf|tél|móvil|contact",
    4: r"(?i)token|secret|passw|api|\bkey|_key|auth|bearer|credential|private",
}
AGAINST = r"(?i)isbn|order|invoice|version|build|date|serial|\bid[ :#]|no\.|page|code|doi|sku|ref|commit|sha|hash|digest|checksum|etag|uuid"
BEFORE = 32

FEATURES = ("kind", "length", "digits", "separators", "groups", "luhn", "bracket", "announced", "denied", "same", "upper", "numbers", "assigned")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def place(i: Column) -> Column:
        return _let((F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48) * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda n, i: n + place(i)) % 10 == 0


def _ip_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(match, r"\."), small)


#: Parts that are put onto one array before a new one is begun, and how deep arrays of arrays go.
GATHERED, LEVELS = 64, 3


def gather(n: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The arrays that ``step`` gives for each number below ``n``, one behind
    the other, as an array of ``kind``. ``step`` takes a carried number (0 at
    first) and the place, and gives an array and the next carried number.

    A fold copies its state at every step. Places are therefore folded in blocks
    of ``GATHERED``, and blocks in blocks, so that a long array is copied once
    for thousands of places and not for each."""

    def state(out: Column, at: Column) -> Column:
        return F.struct(out.alias("out"), at.cast("int").alias("at"))

    def none(of: str) -> Column:
        return F.array().cast(f"array<{of}>")

    def block(number: Column, level: int, at: Column, finish: Callable[[Column], Column]) -> Column:
        """The state after the places of a block, which is that number of its level."""
        width = GATHERED**level
        if level == 1:
            places = F.sequence(number * width, F.least(n, (number + 1) * width) - 1)

            def add(s: Column, i: Column) -> Column:
                out, carried = step(s["at"], i)
                return state(F.concat(s["out"], out), carried)

            return F.aggregate(places, state(none(kind), at), add, finish)
        inside = F.lit(GATHERED) if level < LEVELS else F.ceil(n / (width // GATHERED)).cast("int")
        last = F.least(F.floor((n - 1) / (width // GATHERED)).cast("int"), number * GATHERED + inside - 1)
        parts = F.sequence(number * GATHERED, last)

        def join(s: Column, k: Column) -> Column:
            return block(k, level - 1, s["at"], lambda r: state(F.concat(s["out"], F.array(r["out"])), r["at"]))

        return F.aggregate(parts, state(none(f"array<{kind}>"), at), join, lambda s: finish(state(F.flatten(s["out"]), s["at"])))

    return F.when(n > 0, block(F.lit(0), LEVELS, F.lit(0), lambda s: s["out"])).otherwise(none(kind))


def _located(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column], before: int = 0) -> Column:
    """Matches of a pattern (m) that pass ``valid``, with code-point places: the
    lengths of the matches and of the pieces between them add up. b: the last
    ``before`` characters before a match, back to the start of the last one."""

    def place(both: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column]:
            start, match = at + F.length(F.get(both["p"], i)), F.get(both["m"], i)
            end = start + F.length(match)
            ahead = F.right(F.concat(F.coalesce(F.get(both["m"], i - 1), F.lit("")), F.get(both["p"], i)), F.lit(before)) if before else F.lit("")
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("m"), ahead.alias("b"))
            return F.when(valid(match), F.array(span)).otherwise(F.array().cast(f"array<{_MATCH}>")), end

        return gather(F.size(both["m"]), _MATCH, step)

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), place)


def _guarded(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Base spans in the order of start and kind."""

    def length_between(low: int, high: int) -> Callable[[Column], Column]:
        return lambda m: F.length(digits_of(m)).between(low, high)

    def card(m: Column) -> Column:
        return F.when(F.length(m) < 14, False).otherwise(_let(digits_of(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)))

    digit = text.rlike("[0-9]")
    found = F.concat(
        _guarded(F.contains(text, F.lit("@")), _located(text, _EMAIL, 0, lambda m: F.lit(True))),
        _guarded(text.rlike(r"[0-9]\.[0-9]"), _located(text, _IP, 1, _ip_parts)),
        _guarded(digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _located(text, _CARD, 2, card)),
        _guarded(text.rlike(r"\+[0-9]"), _located(text, _PHONE, 3, length_between(10, 15))),
    )
    return F.array_sort(_bare(found))


def proposals(text: Column) -> Column:
    """Spans of the generators, by start, with their text; they may overlap."""
    found = F.concat(*[_guarded(text.rlike(test), _located(text, pattern, kind, lambda m: F.lit(True), BEFORE)) for kind, test, pattern in GENERATORS])
    return F.array_sort(found)


def features(span: Column) -> dict[str, Column]:
    match, kind, before = span["m"], span["kind"], span["b"]
    digits = digits_of(match)
    announced = reduce(lambda a, k: F.when(kind == k, before.rlike(CONTEXT[k])).otherwise(a), CONTEXT, F.lit(False))
    return {
        "kind": kind,
        "length": F.length(match),
        "digits": F.length(digits),
        "separators": F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")),
        "groups": F.size(F.regexp_extract_all(match, F.lit("[A-Za-z0-9]+"), F.lit(0))),
        "luhn": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False).cast("int"),
        "bracket": match.rlike(r"[(\[{<]").cast("int"),
        "announced": announced.cast("int"),
        "denied": before.rlike(AGAINST).cast("int"),
        "upper": F.length(F.regexp_replace(match, "[^A-Z]", "")),
        "numbers": F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("int"),
        "same": F.length(F.regexp_replace(digits, "^(.)\\1*", "")).eqNullSafe(F.lit(0)).cast("int"),
    }


def load_model(path: str | None = None) -> dict:
    return json.loads(Path(path or Path(__file__).with_name("pii_model.json")).read_text())


def tree_score(values: Column, node: dict | float) -> Column:
    """A tree as nested CASE expressions over a struct of the features."""
    if not isinstance(node, dict):
        return F.lit(float(node))
    return F.when(values[node["feature"]] <= F.lit(float(node["at"])), tree_score(values, node["low"])).otherwise(tree_score(values, node["high"]))


def probability(values: Column, model: dict) -> Column:
    margin = reduce(lambda a, tree: a + tree_score(values, tree), model["trees"], F.lit(float(model["start"])))
    return 1 / (1 + F.exp(-(margin * F.lit(float(model["slope"])) + F.lit(float(model["shift"])))))


def clear_of(base: Column, proposed: Column) -> Column:
    """The proposals that touch no base span, by start. Base spans are taken by
    their start and proposals by their end; a proposal is clear if no base span
    before it in that order reaches beyond its start."""
    event = f"struct<key:int,base:boolean,s:{_MATCH}>"
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("key"), F.lit(True).alias("base"), F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("").alias("m"), F.lit("").alias("b")).alias("s")))
    ends = F.transform(proposed, lambda p: F.struct(p["end"].alias("key"), F.lit(False).alias("base"), p.alias("s")))
    events = F.array_sort(F.concat(spans.cast(f"array<{event}>"), ends.cast(f"array<{event}>")))

    def sift(e: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column]:
            one = F.get(e, i)
            kept = F.when(~one["base"] & (at <= one["s"]["start"]), F.array(one["s"])).otherwise(F.array().cast(f"array<{_MATCH}>"))
            return kept, F.when(one["base"], F.greatest(at, one["s"]["end"])).otherwise(at)

        return F.array_sort(gather(F.size(e), _MATCH, step))

    return _let(events, sift)


def chosen(base: Column, proposed: Column, model: dict) -> Column:
    """Proposals that touch no base span, reach their kind's threshold, and
    beat every other such proposal that they overlap (ties: the earlier, then
    the longer, then the smaller kind)."""

    def scored(span: Column) -> Column:
        values = F.struct(*[v.cast("double").alias(k) for k, v in features(span).items()])
        return F.struct((-_let(values, lambda v: probability(v, model))).alias("p"), span["start"].alias("start"), (-span["end"]).alias("back"), span["kind"].alias("kind"))

    def passes(span: Column) -> Column:
        limit = F.get(F.array(*[F.lit(float(model["thresholds"][k])) for k in KINDS]), span["kind"])
        return -span["p"] >= limit

    def best(spans: Column) -> Column:
        def beaten(s: Column, i: Column) -> Column:
            near = F.slice(spans, F.greatest(i + 1 - NEIGHBOURS, F.lit(1)), F.lit(2 * NEIGHBOURS + 1))
            return F.exists(near, lambda o: (o < s) & (o["start"] < -s["back"]) & (s["start"] < -o["back"]))

        return F.filter(spans, lambda s, i: ~beaten(s, i))

    kept = _let(F.filter(F.transform(clear_of(base, proposed), scored), passes), best)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (-s["back"]).alias("end"))).cast(_SPAN)


def find(docs: DataFrame, *keep: str, model: dict | None = None) -> DataFrame:
    """``keep``, base_spans and spans (base and chosen ones) of every row's
    whole text: arrays of start, kind (index in ``KINDS``) and end, in code
    points, in the order of start and kind. A null or empty text has none;
    repeated rows are treated alike; other columns are left out."""
    model = model or load_model()
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*keep, _let(text, base_spans).alias("base_spans"), _let(text, proposals).alias("_proposed"))
    more = F.when(F.size("_proposed") > 0, _let(F.struct("base_spans", "_proposed"), lambda r: chosen(r["base_spans"], r["_proposed"], model))).otherwise(F.array().cast(_SPAN))
    return found.select(*keep, "base_spans", F.array_sort(F.concat("base_spans", more)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans, and
    n_spans, the number of all."""
    found = find(docs, "doc_id")

    def of_kind(k: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("base_spans", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every span of ``text`` replaced by its kind in brackets,
    like [EMAIL]; overlapping spans become one, named by the first. All rows and
    columns stay, repeated rows are treated alike; null texts stay null; an
    empty table gives an empty result."""
    columns = docs.columns
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text"), "_row")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def part(wide: Column, start: Column, end: Column) -> Column:
        """Four bytes a code point: no part is searched from the text's start."""
        return F.decode(F.substring(wide, 4 * start + 1, 4 * (end - start)), "UTF-32")

    def clean(row: Column) -> Column:
        wide, spans = row["wide"], row["spans"]

        def step(at: Column, i: Column) -> tuple[Column, Column]:
            span = F.get(spans, i)
            shown = F.array(part(wide, at, span["start"]), F.get(names, span["kind"]))
            return F.when(span["start"] >= at, shown).otherwise(F.array().cast("array<string>")), F.greatest(at, span["end"])

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(gather(F.size(spans), "string", step), ""), part(wide, last, F.octet_length(wide)))

    cleaned = F.when(F.size("spans") > 0, _let(F.struct(F.encode(F.col("_row")["text"], "UTF-32").alias("wide"), "spans"), clean)).otherwise(F.col("_row")["text"])
    return found.select(*[cleaned.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns])
