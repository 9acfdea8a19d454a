"""Secret scans through a trigram index, with built-in functions only.

From each rule's pattern follow the trigrams that any match must hold: alternatives, each a set of trigrams. The index
lists the texts of every trigram that some rule asks for; intersecting the lists of an alternative gives the rule's
candidates, and only these are searched with the pattern. Rules without such trigrams search every text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.llm.common import text_or_empty, written

#: A pattern that may begin or end in more ways than this asks for no trigrams at that place.
MOST_ALTERNATIVES = 64
#: Positions are added up within runs of this many matches, then over the runs.
RUN = 256
MARK = "[secret]"


class Rule(NamedTuple):
    """Matches of ``pattern`` whose group ``secret`` (0: the whole match) has at least ``shortest`` characters.

    Shorter matches are dropped but still use up their characters. The secret group must end the match. Letters are
    taken as they stand; write both cases as a class where either will do. ``ahead``: masked before the other rules, as
    its matches may hold theirs and a mark inside would break them. A match never follows a character of the class ``after``, so a
    run of these characters is looked at once and not from each of its places.
    """

    kind: str
    pattern: str
    secret: int = 0
    shortest: int = 1
    ahead: bool = False
    after: str = ""

    @property
    def searched(self) -> str:
        return (f"(?<![{self.after}])" if self.after else "") + f"(?:{self.pattern})"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Where a match is one run of a class, its least length stands in the pattern: a shorter run has no longer one inside.
# The base rules, then formats of published key types.
BASE = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# A private key goes from its header line to the END line over whatever holds fewer than KEY_DASHES runs of dashes shorter than those of
# the END line, as lines "Name: value" may. Without an END line it goes over such lines and all lines of base64 that follow, also where they are indented, quoted or have their line ends written as \\n; of a line that
# goes on with something else, the base64 at its front counts from 16 characters. No loop runs over lines, so that
# Java's stack does not grow with the text.
KEY_HEADER = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
KEY_FIELDS = r"(?:(?:\r?\n|\\r\\n|\\n)[ \t>]*[A-Za-z][A-Za-z0-9-]*: [^\r\n\\]*){0,99}"
KEY_DASHES = 240
KEY_TO_END = rf"[^-]*(?:-{{1,4}}[^-]+){{0,{KEY_DASHES}}}-----END [A-Z ]*PRIVATE KEY-----"
KEY_LINES = (r"""(?:[A-Za-z0-9+/= \t\r\n\\>"',|]*[A-Za-z0-9+/=]{32,})?"""
             r"(?:[\r\n][A-Za-z0-9+/=\r\n]*(?:[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/=](?:[\r\n]|$)))?"
             r"(?:(?:[\r\n]|\\n){0,4}[ \t>]*[A-Za-z0-9+/=]+(?:[\r\n\\]|$))?")
ADDED = (
    Rule("private_key", f"{KEY_HEADER}(?:{KEY_TO_END}|{KEY_FIELDS}{KEY_LINES})", ahead=True),
    Rule("hosting_token", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40, after="A-Za-z0-9_-"),
)
RULES = BASE + ADDED


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, one of which every match holds in full; None if none are mandatory."""
    from re import _parser as parser

    gap = None  # stands between literals for anything else

    def joined(heads: list[tuple], tails: list[tuple]) -> list[tuple]:
        if len(heads) * len(tails) > MOST_ALTERNATIVES:
            return [(*head, gap) for head in heads]
        return [(*head, *tail) for head in heads for tail in tails]

    def walk(items) -> list[tuple]:
        ways = [()]
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                more = [(chr(value).lower(),)]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
                letters = {chr(v).lower() for _, v in value}
                more = [(letters.pop(),)] if len(letters) == 1 else [(gap,)]
            elif name == "SUBPATTERN":
                more = walk(value[-1])
            elif name == "BRANCH":
                more = [way for branch in value[1] for way in walk(branch)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
                more = [*walk(value[2]), *([()] if value[0] == 0 else [])]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0]:
                more = [(*way, gap) for way in walk(value[2])]
            else:
                more = [(gap,)]
            ways = joined(ways, more)
        return ways

    found = []
    for way in walk(parser.parse(pattern)):
        runs = "".join("\n\n" if c is gap else c for c in way).split("\n\n")
        found.append(frozenset(run[i:i + 3] for run in runs for i in range(len(run) - 2)))
    if not all(found):
        return None
    return [clause for clause in dict.fromkeys(found) if not any(other < clause for other in found)]


def candidates(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(_key, _rules): for each text in ``texts(_key, _text)`` the numbers of the rules it has to be searched for."""
    queries = {n: found for n, rule in enumerate(rules) if (found := trigram_query(rule.pattern))}
    clauses = [(n, c, sorted(clause)) for n, found in queries.items() for c, clause in enumerate(found)]
    trigrams = sorted({t for *_, clause in clauses for t in clause})
    folded = texts.select("_key", F.lower("_text").alias("_low"))
    hits = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), t) for t in trigrams]))
    postings = folded.select("_key", F.explode(hits).alias("_trigram"))
    asked = {t: F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(c).alias("clause"), F.lit(1 << clause.index(t)).cast("long").alias("bit"),
                                   F.lit((1 << len(clause)) - 1).cast("long").alias("full"))
                          for n, c, clause in clauses if t in clause]) for t in trigrams}
    lookup = F.create_map(*[x for t, found in asked.items() for x in (F.lit(t), found)])
    inside = (postings.select("_key", F.explode(lookup[F.col("_trigram")]).alias("_q"))
              .groupBy("_key", "_q.rule", "_q.clause", "_q.full").agg(F.bit_or("_q.bit").alias("_bits")).where("_bits = full"))
    return inside.groupBy("_key").agg(F.collect_set("rule").alias("_rules"))  # at most one entry per rule


def _matches(text: Column, rule: Rule) -> Column:
    """Consecutive parts of the text, each ending with a match."""
    return F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?){rule.searched}"), F.lit(0))


def _secret(part: Column, rule: Rule) -> Column:
    return F.regexp_extract(part, rule.searched, rule.secret)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _ends(sizes: Column) -> Column:
    """Running totals: within runs of ``RUN`` numbers, each run starting from the sum of those before it."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: F.slice(sizes, k * RUN + 1, F.lit(RUN)))

    def added(all_runs: Column, sums: Column) -> Column:
        return F.flatten(F.transform(all_runs, lambda run, k: _bound(_total(F.slice(sums, F.lit(1), k)), lambda before: F.transform(
            run, lambda _, i: before + _total(F.slice(run, F.lit(1), i + 1))))))
    found = _bound(runs, lambda all_runs: _bound(F.transform(all_runs, _total), lambda sums: added(all_runs, sums)))
    return F.when(F.size(sizes) > 0, found).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Array of (start, number, kind, end) of the matches that count."""
    def of_parts(parts: Column) -> Column:
        ends = _bound(F.transform(parts, F.char_length), _ends)
        whole = F.zip_with(parts, ends, lambda part, end: F.struct(
            (end - F.char_length(F.regexp_extract(part, rule.searched, 0))).alias("start"), F.lit(number).alias("number"),
            F.lit(rule.kind).alias("kind"), end.alias("end"), F.char_length(_secret(part, rule)).alias("size")))
        kept = F.filter(whole, lambda x: x["size"] >= rule.shortest)
        return F.transform(kept, lambda x: F.struct(x["start"], x["number"], x["kind"], x["end"]))
    return _bound(_matches(text, rule), of_parts)


def _searched(docs: DataFrame, id_cols: Sequence[str], text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """``docs`` with _text, and _rules: the numbers of the rules to search for."""
    key = F.unhex(F.substring(F.sha2(F.col("_text").cast("binary"), 256), 1, 32))
    texts = docs.select(*id_cols, text_or_empty(text_col).alias("_text")).withColumn("_key", key)
    always = [n for n, rule in enumerate(rules) if not trigram_query(rule.pattern)]
    found = written(candidates(texts.select("_key", "_text"), rules), "secret-candidates")
    return (texts.join(found, "_key", "left")
            .withColumn("_rules", F.concat(F.coalesce("_rules", F.array().cast("array<int>")), F.array(*map(F.lit, always)).cast("array<int>"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(_id, _spans) of every row: an array of (start, number, kind, end), by start and then in the order of the rules.

    Positions count code points from 0, the end is exclusive; spans of one rule never overlap, those of different rules
    may. A null or empty text has none. Repeated rows stay repeated, null ids stay null, an empty table gives an empty
    result, other columns are not read.
    """
    searched = _searched(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), ["_id"], "_body", rules)
    empty = F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")
    spans = [F.when(F.array_contains("_rules", n), _spans(F.col("_text"), n, rule)).otherwise(empty) for n, rule in enumerate(rules)]
    return searched.select("_id", F.array_sort(F.concat(*spans)).alias("_spans"))


def _cleaned(rule: Rule, text: Column) -> Callable[[Column], Column]:
    """From the parts that end with a match, the whole text with the secrets of the rule masked."""
    def masked(part: Column) -> Column:
        size = F.char_length(_secret(part, rule))
        return F.when(size >= rule.shortest, F.concat(F.substring(part, F.lit(1), F.char_length(part) - size), F.lit(MARK))).otherwise(part)

    def whole(parts: Column) -> Column:
        done = F.aggregate(parts, F.lit(0), lambda a, x: a + F.char_length(x))
        return F.concat(F.array_join(F.transform(parts, masked), ""), F.substring(text, done + 1, F.char_length(text)))
    return whole


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by a mark and its length column, if any, brought up to date; all rows stay.

    The rules run one after another, those that go ``ahead`` first, so a secret that several rules see is replaced once.
    Null texts stay null.
    """
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]  # names of the caller cannot clash with those used here
    at = dict(zip(names, inner))
    searched = _searched(docs.toDF(*inner), inner, at[text_col], rules)
    old = F.col(at[text_col])
    for n, rule in sorted(enumerate(rules), key=lambda x: not x[1].ahead):
        found = _bound(_matches(F.col("_text"), rule), _cleaned(rule, F.col("_text")))
        searched = searched.withColumn("_text", F.when(F.array_contains("_rules", n), found).otherwise(F.col("_text")))
    changed = old.isNotNull() & (F.col("_text") != old)
    put = {at[text_col]: F.when(changed, F.col("_text")).otherwise(old)}
    if size_col in at:
        put[at[size_col]] = F.when(changed, F.char_length("_text").cast(docs.schema[size_col].dataType)).otherwise(F.col(at[size_col]))
    return searched.withColumns(put).select(*inner).toDF(*names)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans_sql(rules: Sequence[Rule] = RULES, base: int = len(BASE)) -> str:
    """DuckDB SQL of the same spans: each pattern over every text, without an index."""
    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")
    lists = []
    for n, rule in enumerate(rules):
        whole = f"(?s)(.*?{f'(?:^|[^{rule.after}])' if rule.after else ''})({quoted(rule.pattern)})"
        lists.append(f"""list_transform(list_zip(
  regexp_extract_all(body, '{whole}', 1), regexp_extract_all(body, '{whole}', 2), regexp_extract_all(body, '{whole}', {rule.secret + 2})), lambda x, i: struct_pack(
  gap := length(x[1]), size := length(x[2]), keep := length(x[3]) >= {rule.shortest})) AS m{n}""")
    starts = []
    for n, rule in enumerate(rules):
        starts.append(f"""list_transform(list_filter(list_transform(m{n}, lambda x, i: struct_pack(
  start := coalesce(list_sum(list_transform(m{n}[:i - 1], lambda y: y.gap + y.size)), 0)::BIGINT + x.gap, number := {n}, kind := '{rule.kind}',
  size := x.size, keep := x.keep)), lambda x: x.keep), lambda x: struct_pack(start := x.start, number := x.number, kind := x.kind, stop := x.start + x.size))""")
    joined = "list_transform({}, lambda x: x.kind || ':' || x.start || ':' || x.stop)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS (SELECT doc_id, {", ".join(lists)} FROM t),
s AS (SELECT doc_id, list_sort(flatten([{", ".join(starts)}])) AS spans FROM m)
SELECT doc_id, len(list_filter(spans, lambda x: x.kind = 'assign'))::BIGINT AS n_assign, len(list_filter(spans, lambda x: x.kind = 'access'))::BIGINT AS n_access,
  len(list_filter(spans, lambda x: x.kind = 'hex'))::BIGINT AS n_hex,
  sha256(array_to_string({joined.format(f"list_filter(spans, lambda x: x.number < {base})")}, ',')) AS base_sha256,
  array_to_string({joined.format("spans")}, ',') AS spans
FROM s"""
