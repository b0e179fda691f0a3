"""Personal data: fixed patterns, and boosted trees over high-recall candidates.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers; their
checks (octet range, Luhn, digit counts) drop matches without retrying. Beside them, broad
generators propose overlapping number-like and address-like spans, among them every Luhn-valid
row of groups inside a longer number and phones without their prefix. Format and context make a
bit pattern of each candidate, in which the marks that the fixed patterns ask for ("@", "+") do
not show; boosted trees learn from all documents which patterns mark spans that the fixed
patterns confirm, and a threshold calibrated on a held-out fold selects further spans that look
the same but that no fixed pattern covers. Candidates that no fixed pattern could confirm as they
stand (spelled-out addresses, parts of a longer number) are no examples, only selected from.

Only built-in expressions are used. Spark gives matches without positions, so positions come
from the lengths of what ``split`` leaves between them. The patterns below are possessive
forms of the stated ones: they match the same spans, without deep recursion on long runs.

One scan trains (counts by pattern: at most 2^BITS rows leave a task), one scan applies.
Null text is empty. Texts of any length are searched whole. Rows that repeat are judged alike; an
empty table trains a model that selects nothing. Spans count code points, end exclusive. Extra
columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm import boosting

KINDS = ("email", "ip", "card", "phone")
EXTRA = "likely"
#: Where a run of an address's first part begins: not inside one, but for the end of the match before.
LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
EMAIL = LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"

NUMBER_LIKE = r"(?<![0-9])[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"
ADDRESS_LIKE = LOCAL + r"\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9][A-Za-z0-9.-]*+"
PHONE_LIKE = r"(?<![0-9])\(?[0-9]{2,5}\)?[\x20.-]?[0-9]{2,4}[\x20.-][0-9]{3,5}(?![0-9])"
#: Numbers long enough for a card, and how many of their groups in a row may be one.
CARD_RUN = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+"
CARD_GROUPS, CARD_LONGEST = 5, 19
SPELLED = r"[(\[]at[)\]]"
CONTEXT = 24
SCAN_BLOCK = 64
HIT = "struct<hit:string,before:string,after:string,start:int,end:int>"
HINTS = r"(?i)phone|tel|call|fax|card|visa|pay|mail|contact|write|address|host|server|ssn|passport|account"
#: Share of held-out selections that fixed patterns must confirm.
PRECISION = 0.95
FOLDS = 5

#: The bits of a candidate's pattern over c.hit, c.before, c.after and n_, its digits; in order.
FEATURES = {
    "address": rf"c.hit rlike r'@|{SPELLED}'",
    "domain": rf"c.hit rlike r'(?:@|{SPELLED})\x20?[A-Za-z0-9-]+\.[A-Za-z0-9]'",
    "digits_8": "n_ >= 8",
    "digits_12": "n_ >= 12",
    "digits_16": "n_ >= 16",
    "digits_20": "n_ >= 20",
    "has_dot": "contains(c.hit, '.')",
    "three_dots": r"c.hit rlike r'^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$'",
    "grouped": r"c.hit rlike r'[\x20()-]'",
    "luhn": "n_ BETWEEN 13 AND 19 AND LUHN",
    "hinted": f"c.before rlike r'{HINTS}'",
    "glued": "(c.before rlike r'[A-Za-z0-9_./-]$' OR c.after rlike r'^[A-Za-z0-9_/]')",
}
BITS = len(FEATURES)


# The functions below write SQL: every expression is a string, parsed once.
def _let(value: str, name: str, body: str) -> str:
    """The body with the value bound to a name, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _none(kind: str) -> str:
    return f"cast(array() as array<{kind}>)"


def _scan(rows: str, first: str, state: str, step, kind: str) -> str:
    """The values that step(state, row), a struct of the next state and a value, gives for each row in turn.

    state and kind are the types of states and values, first is the first state. Appending copies
    an array, so rows go in blocks: steps are appended to a block's, and blocks to the whole.
    """
    pair = f"struct<state:{state},value:{kind}>"
    before = f"CASE WHEN size(all_) > 0 THEN element_at(element_at(all_, -1), -1).state ELSE {first} END"
    part = f"aggregate(part_, array(cast(named_struct('state', {before}, 'value', null) as {pair})), (one_, x_) -> concat(one_, array({step('element_at(one_, -1).state', 'x_')})))"
    blocks = f"transform(sequence(1, size(rows_), {SCAN_BLOCK}), k_ -> transform(sequence(k_, least(k_ + {SCAN_BLOCK - 1}, size(rows_))), j_ -> get(rows_, j_ - 1)))"
    values = f"flatten(transform(all_, o_ -> transform(slice(o_, 2, {SCAN_BLOCK}), v_ -> v_.value)))"
    every = f"aggregate({blocks}, {_none(f'array<{pair}>')}, (all_, part_) -> concat(all_, array({part})), all_ -> {values})"
    return _let(rows, "rows_", f"CASE WHEN size(rows_) > 0 THEN {every} ELSE {_none(kind)} END")


def _matches(text: str, pattern: str, valid=None) -> str:
    """Array of (hit, before, after, start, end) of the pattern's matches that are valid."""

    def step(at: str, x: str) -> str:
        start = f"{at} + length({x}.piece)"
        end = f"{start} + length({x}.hit)"
        return f"named_struct('state', {end}, 'value', named_struct('hit', {x}.hit, 'before', right({x}.piece, {CONTEXT}), 'after', {x}.after, 'start', {start}, 'end', {end}))"

    numbered = f"transform(hits_, (h_, i_) -> named_struct('hit', h_, 'piece', get(pieces_, i_), 'after', left(get(pieces_, i_ + 1), {CONTEXT})))"
    every = _scan(numbered, "0", "int", step, HIT)
    if valid:
        every = f"filter({every}, y_ -> {valid('y_.hit')})"
    some = f"exists(hits_, h_ -> {valid('h_')})" if valid else "size(hits_) > 0"
    placed = _let(f"split({text}, r'{pattern}', -1)", "pieces_", every)
    return _let(f"regexp_extract_all({text}, r'{pattern}', 0)", "hits_", f"CASE WHEN {some} THEN {placed} ELSE {_none(HIT)} END")


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits passes Luhn's check."""
    doubled = _let("try_cast(c_ as int) * (i_ % 2 + 1)", "v_", "CASE WHEN v_ > 9 THEN v_ - 9 ELSE v_ END")
    return f"(aggregate(transform(split(reverse({digits}), ''), (c_, i_) -> {doubled}), 0, (s_, v_) -> s_ + coalesce(v_, 0)) % 10 = 0)"


def _card(hit: str) -> str:
    return _let(_digits(hit), "d_", f"CASE WHEN length(d_) BETWEEN 16 AND 19 THEN {luhn('d_')} ELSE false END")


def base_spans(text: str) -> str:
    """Array of (kind, start, end) of the fixed patterns, by kind as listed, then start."""
    only_if = lambda sign, found: f"CASE WHEN contains({text}, '{sign}') THEN {found} ELSE {_none(HIT)} END"
    of = {
        "email": only_if("@", _matches(text, EMAIL)),
        "ip": _matches(text, IP, lambda h: f"{h} rlike r'{OCTETS}'"),
        "card": _matches(text, CARD, _card),
        "phone": only_if("+", _matches(text, PHONE, lambda h: f"length({_digits(h)}) BETWEEN 8 AND 15")),
    }
    kept = [f"transform({of[kind]}, z_ -> named_struct('kind', '{kind}', 'start', cast(z_.start as bigint), 'end', cast(z_.end as bigint)))" for kind in KINDS]
    return f"concat({', '.join(kept)})"


def _card_parts(text: str) -> str:
    """Array like that of _matches: the rows of up to CARD_GROUPS groups inside long numbers that pass as cards."""

    def step(state: str, x: str) -> str:
        """x is a group with the separator behind it, if it has one; w_ is the state after it."""
        held = _let(f"concat({state}.recent, array({x}))", "held_", f"CASE WHEN size(held_) > {CARD_GROUPS} THEN slice(held_, 2, {CARD_GROUPS}) ELSE held_ END")
        now = f"named_struct('at', {state}.at + length({x}), 'tail', right(concat({state}.tail, {x}), {CONTEXT + 2 * CARD_LONGEST}), 'recent', {held})"
        edge = f"(length({x}) - length({_digits(x)}))"
        last = "array_join(slice(w_.recent, -n_, n_), '')"
        passes = _let(f"translate({last}, ' -', '')", "d_", f"CASE WHEN length(d_) BETWEEN 13 AND {CARD_LONGEST} THEN {luhn('d_')} ELSE false END")
        before = f"right(left(w_.tail, length(w_.tail) - length(l_)), {CONTEXT})"
        after = f"CASE WHEN {edge} > 0 THEN right({x}, 1) ELSE run_.after END"
        one = _let(last, "l_", f"named_struct('hit', left(l_, length(l_) - {edge}), 'before', {before}, 'after', {after}, 'start', w_.at - length(l_), 'end', w_.at - {edge})")
        some = f"transform(filter(sequence(1, size(w_.recent)), n_ -> {passes}), n_ -> {one})"
        found = f"CASE WHEN length(array_join(w_.recent, '')) >= 13 THEN {some} ELSE {_none(HIT)} END"
        return _let(now, "w_", f"named_struct('state', w_, 'value', {found})")

    first = f"named_struct('at', run_.start, 'tail', run_.before, 'recent', {_none('string')})"
    groups = r"regexp_extract_all(run_.hit, r'[0-9]+[\x20-]?', 0)"
    return f"flatten(transform({_matches(text, CARD_RUN)}, run_ -> flatten({_scan(groups, first, 'struct<at:int,tail:string,recent:array<string>>', step, f'array<{HIT}>')})))"


def candidates(text: str) -> str:
    """Array of (start, end, mask, blind) from the broad generators; they may overlap.

    Blind ones are those that no fixed pattern could confirm as they stand.
    """
    sign = " OR ".join(f"contains({text}, '{x}')" for x in ("@", "(at)", "[at]"))
    addresses = f"CASE WHEN {sign} THEN {_matches(text, ADDRESS_LIKE)} ELSE {_none(HIT)} END"
    bits = [f"CASE WHEN {test.replace('LUHN', luhn(_digits('c.hit')))} THEN {1 << i}L ELSE 0L END" for i, test in enumerate(FEATURES.values())]
    mask = _let(f"length({_digits('c.hit')})", "n_", " + ".join(bits))
    proposed = lambda found, blind: f"transform({found}, c -> named_struct('start', cast(c.start as bigint), 'end', cast(c.end as bigint), 'mask', {mask}, 'blind', {blind}))"
    every = [(_matches(text, NUMBER_LIKE), "false"), (_matches(text, PHONE_LIKE), "false"), (_card_parts(text), "true"), (addresses, f"c.hit rlike r'{SPELLED}'")]
    return f"concat({', '.join(proposed(*x) for x in every)})"


def _confirmed(cands: str, base: str) -> str:
    """Candidates by start, each with ``yes``, whether a fixed span overlaps it.

    Two scans over fixed spans and candidates in order of their start.
    """
    row = lambda x, mask, blind, fixed: f"named_struct('start', {x}.start, 'end', {x}.end, 'mask', {mask}, 'blind', {blind}, 'fixed', {fixed}, 'yes', false)"
    kind = "struct<start:bigint,end:bigint,mask:bigint,blind:boolean,fixed:boolean,yes:boolean>"
    rows = f"array_sort(concat(transform({base}, b_ -> {row('b_', '0L', 'false', 'true')}), transform(cands_, c_ -> {row('c_', 'c_.mask', 'c_.blind', 'false')})))"

    def swept(order: str, first: int, reach: str, overlaps: str) -> str:
        """Fixed spans move the state (s); a row overlaps one that came before it in the order."""

        def step(state: str, x: str) -> str:
            of = lambda sql: sql.replace("s.", state + " ").replace("x.", f"{x}.")
            yes = f"{x}.yes OR {of(overlaps)}"
            value = f"named_struct('start', {x}.start, 'end', {x}.end, 'mask', {x}.mask, 'blind', {x}.blind, 'fixed', {x}.fixed, 'yes', {yes})"
            return f"named_struct('state', CASE WHEN {x}.fixed THEN {of(reach)} ELSE {state} END, 'value', {value})"

        return _scan(order, f"{first}L", "bigint", step, kind)

    ahead = swept(rows, -1, "greatest(s., x.end)", "s. > x.start")
    back = swept(f"reverse({ahead})", 1 << 62, "least(s., x.start)", "s. < x.end")
    plain = lambda x, yes: f"named_struct('start', {x}.start, 'end', {x}.end, 'mask', {x}.mask, 'blind', {x}.blind, 'yes', {yes})"
    kept = f"transform(filter({back}, f_ -> NOT f_.fixed), f_ -> {plain('f_', 'f_.yes')})"
    alone = f"transform(cands_, c_ -> {plain('c_', 'false')})"
    return _let(cands, "cands_", f"array_sort(CASE WHEN size({base}) > 0 AND size(cands_) > 0 THEN {kept} ELSE {alone} END)")


def _found(docs: DataFrame, text: str) -> DataFrame:
    """docs with _text, _base and _cand, the fixed spans and the candidates of the text."""
    given = docs.withColumn("_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return given.withColumn("_base", F.expr(base_spans("_text"))).withColumn("_cand", F.expr(_confirmed(candidates("_text"), "_base")))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", precision: float = PRECISION) -> tuple[boosting.Model, float]:
    """Trees and threshold, from the counts of every candidate's pattern in docs."""
    rows = _found(docs.select(F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(FOLDS)).alias("fold"), F.col(f"`{text}`").alias("text")), "text")
    each = rows.select("fold", F.explode(F.transform(F.filter("_cand", lambda c: ~c["blind"]), lambda c: F.struct(c["mask"], c["yes"]))).alias("c"))
    counts = each.groupBy("c.mask", (F.col("fold") == 0).alias("held")).agg(F.sum(F.col("c.yes").cast("long")).alias("yes"), F.count("*").alias("n")).orderBy("mask", "held").collect()  # at most 2^(BITS + 1) rows
    part = lambda held: [np.array(x, dtype) for x, dtype in zip(zip(*[(r["mask"], r["yes"], r["n"] - r["yes"]) for r in counts if r["held"] == held], strict=True), (np.int64, float, float), strict=False)] or [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
    masks, yes, no = part(False)
    model = boosting.fit(masks, yes, no, BITS)
    masks, yes, no = part(True)
    return model, boosting.threshold(model.margins(masks), yes, no, precision)


def find_pii(docs: DataFrame, model: boosting.Model, least: float, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with an array of (kind, start, end): fixed spans, then likely ones.

    A column of docs that is named like the array is replaced.
    """
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").alias("_text"))
    found = _found(inside, "_text")
    chosen = F.filter("_cand", lambda c: ~c["yes"] & (model.expression(c["mask"]) >= F.lit(least)))
    # Candidates come in order, so equal spans of several generators are neighbours.
    other = lambda c, i: (i == 0) | (F.get(c, i - 1)["start"] != F.get(c, i)["start"]) | (F.get(c, i - 1)["end"] != F.get(c, i)["end"])
    found = found.withColumn("_chosen", chosen)
    chosen = F.col("_chosen")
    likely = F.transform(F.filter(chosen, lambda x, i: other(chosen, i)), lambda x: F.struct(F.lit(EXTRA).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    spans = F.concat(F.col("_base"), likely)
    kept = [spans.alias(c) if c == into else F.col(f"_doc.`{c}`") for c in docs.columns]
    return found.select(*kept, *([] if into in docs.columns else [spans.alias(into)]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, *train(docs))
    of = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["kind"].isin(*KINDS))
    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def pii_base(spark, sf_dir: str) -> DataFrame:
    """What the fixed patterns find, by the same expressions, without the trees."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.withColumn("pii", F.expr(base_spans("text")))
    of = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(_joined(F.col("pii")), 256).alias("base_sha256"))
