"""Secret scan over trigram postings, in DataFrame functions only.

From each rule's pattern the trigrams that a match must hold are derived, as alternatives of conjunctions. A rule's
candidates are the rows that stand in all postings of one of its alternatives; they are verified by the pattern itself. A
rule with an alternative without a trigram is run over every row.

``build_index`` stores the postings as a table, ``search_index`` intersects them there, and ``scan`` with an index verifies only
the rows it names. A row is named by a hash of its id and text: two rows of one hash are both verified, so nothing depends on
ids being there or being different. Without an index ``scan`` reads a row's postings off its own text and keeps them beside
it, so texts do not move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanework.llm import _base


@dataclass(frozen=True)
class Rule:
    """pattern: what Java's and Python's expressions share. A match counts if its group has at least min_chars characters."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1


#: A bounded repeat gives the same spans as the open one with shorter matches dropped, where matches are whole runs.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
#: How many of the rules are the base ones.
BASE_RULES = 3
#: Letters of English texts, most frequent first (a fixed value): what is rarer in it is looked for first.
FREQUENT = "etaoinshrdlucmfwypvbgkjqxz"
#: Matches whose places are summed up in one go.
PLACES = 256
MARK = "[SECRET]"


def literal_runs(pattern: str) -> list[frozenset[str]]:
    """Alternatives of a pattern, each as the lower-case literal strings that every match of it contains.

    The pattern may hold literals, \\xHH and escaped characters, classes, groups, alternation and repeats.
    """
    at = 0
    # A state: the literals that are complete, and the one that goes on.
    State = list[tuple[frozenset[str], str]]  # noqa: N806
    cut = lambda states: [(runs | {tail}, "") for runs, tail in states]

    def alternatives(states: State) -> State:
        nonlocal at
        found = sequence(states)
        while pattern[at : at + 1] == "|":
            at += 1
            found = found + sequence(states)
        return found

    def sequence(states: State) -> State:
        nonlocal at
        while at < len(pattern) and pattern[at] not in "|)":
            before, start = states, at
            if pattern[at] == "(":
                at += 1
                if pattern[at] == "?":
                    at = pattern.index(":", at) + 1
                states = alternatives(states)
                at += 1
            elif pattern[at] == "[":
                at = pattern.index("]", at + 2) + 1
                states = cut(states)
            elif pattern.startswith("\\x", at):
                states = [(runs, tail + chr(int(pattern[start + 2 : start + 4], 16)).lower()) for runs, tail in states]
                at += 4
            elif pattern[at] in ".^$" or (pattern[at] == "\\" and pattern[at + 1].isalnum()):
                at += 1 + (pattern[at] == "\\")
                states = cut(states)
            else:
                at += pattern[at] == "\\"
                states = [(runs, tail + pattern[at].lower()) for runs, tail in states]
                at += 1
            if (sign := pattern[at : at + 1]) and sign in "?*+{":
                at = pattern.index("}", at) + 1 if sign == "{" else at + 1
                least = int(pattern[start:at].rsplit("{", 1)[1].split(",")[0].rstrip("}")) if sign == "{" else int(sign == "+")
                states = before + states if sign == "?" else cut(states) if least else cut(before)
        return states

    return list({frozenset(x for x in runs | {tail} if x) for runs, tail in alternatives([(frozenset(), "")])})


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigram conjunctions, or None where an alternative has no trigram."""
    found = {frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in literal_runs(pattern)}
    return None if frozenset() in found else sorted(found, key=sorted)


def rarest_first(trigrams: frozenset[str]) -> list[str]:
    return sorted(trigrams, key=lambda t: (-sum(len(FREQUENT) if c not in FREQUENT else FREQUENT.index(c) for c in t), t))


def candidate_kinds(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The kinds of rules whose trigram query a text satisfies; the text is lower-cased once."""
    queries = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern)) is not None]

    def kinds(low: Column) -> Column:
        found = []
        for kind, query in queries:
            some = F.lit(False)
            for trigrams in query:
                every = F.lit(True)
                for t in rarest_first(trigrams):
                    every = every & F.contains(low, F.lit(t))
                some = some | every
            found.append(F.when(some, F.lit(kind)))
        return F.array_compact(F.array(*found))

    return F.transform(F.array(F.lower(text)), kinds)[0] if queries else F.array().cast("array<string>")


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key): stored postings of the trigrams that the rules ask for, by trigram within a file, so that a lookup skips
    the row groups of others; key is xxhash64(doc_id, text). Null texts have no postings."""
    wanted = sorted({t for r in rules for part in trigram_query(r.pattern) or () for t in part})
    rows = docs.select(_base.text_key(doc_id, text).alias("key"), F.lower(F.col(text)).alias("low"))
    held = F.filter(F.array(*(F.lit(t) for t in wanted)), lambda t: F.contains(F.col("low"), t)) if wanted else F.array().cast("array<string>")
    return _base.save(rows.select(F.explode(held).alias("trigram"), "key").sortWithinPartitions("trigram"), "postings")


def search_index(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): the candidates in stored postings, a row each, with the rules that they are candidates of.

    The postings meet by key: one shuffle of the rules' postings, combined before it, gives the trigrams of a key (no more than
    the rules ask for), and a rule stays if all trigrams of one of its alternatives are among them.
    """
    queries = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern)) is not None]
    wanted = sorted({t for _, q in queries for part in q for t in part})
    met = index.where(F.col("trigram").isin(*wanted)).groupBy("key").agg(F.collect_set("trigram").alias("held"))
    within = lambda part: F.size(F.array_intersect("held", F.array(*(F.lit(t) for t in sorted(part))))) == len(part)
    kinds = [F.when(F.greatest(*map(within, q), F.lit(False)), F.lit(kind)) for kind, q in queries]
    found = met.select("key", (F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")).alias("kinds"))
    return found.where(F.size("kinds") > 0)


SPANS = "array<struct<start:bigint,kind_order:int,end:bigint>>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_order, end>> of one rule, leftmost and non-overlapping, in code points.

    Matches and the gaps between them alternate, so the sums of their lengths are their places. They are summed up within
    blocks of matches and over the blocks: the work grows with the matches, not with their square.
    """

    def places(whole: Column) -> Column:
        value = lambda x: x if rule.group == 0 else F.regexp_extract(x, rule.pattern, rule.group)
        lengths = F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), whole, lambda gap, x: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(x).cast("bigint").alias("size"), (F.length(value(x)) >= rule.min_chars).alias("kept")))
        return F.transform(F.array(lengths), in_blocks)[0]

    def in_blocks(lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PLACES).cast("int")), lambda b: F.slice(lengths, b * PLACES + 1, F.lit(PLACES)))
        return F.transform(F.array(blocks), joined)[0]

    def joined(blocks: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x["gap"] + x["size"]))
        starts = F.aggregate(sums, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), one_block))

    def one_block(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["size"]
            span = F.struct(start.alias("start"), F.lit(order).cast("int").alias("kind_order"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["kept"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(SPANS).alias("spans"))

        first = F.struct(at.alias("at"), F.array().cast(SPANS).alias("spans"))
        return F.aggregate(block, first, step, lambda acc: acc["spans"])

    found = F.array(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    return F.transform(found, lambda whole: F.when(F.size(whole) > 0, places(whole)).otherwise(F.array().cast(SPANS)))[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(docs' columns, secret_spans): spans of every row, sorted by start, then by the rules' order.

    index: what ``build_index`` stored for these rows (or more) and rules (or more). Its candidates meet the rows by key, which
    moves the rows once, unless Spark finds the candidates small enough to send them; copies of a text have different keys
    unless their ids are equal too. Without an index nothing is shuffled.

    A null text counts as empty; null ids and equal rows are ordinary rows; an empty table gives an empty result. A column
    called secret_spans is replaced.
    """
    docs = docs.drop("secret_spans")
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if index is None:
        rows = rows.withColumn("kinds", candidate_kinds(F.col("body"), rules))
    else:
        at = lambda c: f"c{names.index(c)}"
        found = search_index(index, rules).select("key", F.col("kinds").alias("found"))
        rows = rows.withColumn("key", _base.text_key(at(doc_id), at(text))).join(found, "key", "left")
        rows = rows.withColumn("kinds", F.coalesce("found", F.array().cast("array<string>")))
    parts = []
    for i, rule in enumerate(rules):
        spans = rule_spans(F.col("body"), rule, i)
        parts.append(spans if trigram_query(rule.pattern) is None else F.when(F.array_contains("kinds", rule.kind), spans).otherwise(F.array().cast(SPANS)))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.array_sort(F.concat(*parts)).alias("secret_spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_order"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every span, or union of overlapping spans, replaced by the mark."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["text"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(acc["text"]).alias("text"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text"))
    done = F.aggregate(spans, first, step, lambda acc: F.concat(acc["text"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
