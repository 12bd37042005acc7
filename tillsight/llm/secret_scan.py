"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived. The index posts, for
every document, the trigrams that some query uses; postings meet per document, the queries are
evaluated on them, and only the candidates' texts are searched with the expression. Rules whose
expression guarantees no trigram (a long run of hexadecimal digits) search every text."""

from __future__ import annotations

from itertools import product
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, whole_texts

_EXACT_MOST = 64    # strings that an expression part is spelled out to, at most


class Rule:
    """kind; pattern (Java and Python syntax); group and least length of what must be long enough."""

    def __init__(self, kind: str, pattern: str, group: int, least: int):
        self.kind, self.pattern, self.group, self.least = kind, pattern, group, least
        self.query = trigram_query(pattern)


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The three base rules; letters of the first rule's names in either case.
_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))


def _strings(tree) -> set[str] | None:
    """All lower-cased strings that a parsed expression can match, or None if there are too many."""
    out = {""}
    for op, arg in tree:
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            part = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
            one = _strings(arg[2])
            part = None if one is None else {"".join(p) for k in range(arg[0], arg[1] + 1) for p in product(one, repeat=k)}
        else:
            part = None
        if part is None or len(out) * len(part) > _EXACT_MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[set[str]]:
    """Alternatives, each a set of trigrams that a matching lower-cased text has all of; an empty
    list means that no trigram is certain and every text must be searched."""
    best: list[set[str]] = []

    def offer(strings):
        nonlocal best
        query = [{s[i:i + 3] for i in range(len(s) - 2)} for s in sorted(strings)]
        if all(query) and (not best or min(map(len, query)) > min(map(len, best))):
            best = query

    def walk(tree):
        run = {""}
        for item in [*tree, None]:
            optional = item and item[0] in (C.MAX_REPEAT, C.MIN_REPEAT) and item[1][0] == 0
            part = _strings([item]) if item and not optional else None
            if part is None or len(run) * len(part) > _EXACT_MOST:
                offer(run)
                run = part or {""}
                if part is None and item and item[0] is C.SUBPATTERN:
                    walk(item[1][3])
                elif part is None and item and item[0] in (C.MAX_REPEAT, C.MIN_REPEAT) and item[1][0] > 0:
                    walk(item[1][2])
            else:
                run = {a + b for a in run for b in part}
        offer(run)

    walk(_parser.parse(pattern))
    return best


BASE_RULES = [
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
]
# A PEM key: from BEGIN to its END, with whatever stands between but no other line of five dashes;
# where END is missing, the header lines and the body, which are long base64 chunks in any wrapping
# and whole lines of base64. As no choice in a loop is taken back, Java's loops can be possessive.
_PEM_LINE = r"[ \t\r]*\n[ \t]*"
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_PEM_LINE}(?:[A-Z][A-Za-z]*-[A-Za-z-]+|Comment):[^\n]*)*"
    rf"""(?:(?:\\[nr]|[ \t\r\n"'>|#*,])*[A-Za-z0-9+/]{{20,}}={{0,2}}"""
    rf"|(?:\\r)?\\n[A-Za-z0-9+/]+={{0,2}}|{_PEM_LINE}[A-Za-z0-9+/]+={{0,2}}[ \t\r]*(?m:$))*)")
# Rules that the method adds to the base ones; their spans come after the base kinds at the same start.
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("private_key", _PRIVATE_KEY, 0, 27),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]+", 0, 20),
]


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _search_pattern(rule: Rule) -> str:
    # a run of one class shorter than asked for can't become a match from a later start
    if rule.kind == "hex":
        return f"[0-9a-f]{{{rule.least},}}"
    if rule.kind == "private_key":      # Java's greedy loops take stack for each turn, its $ knows more line ends
        return rule.pattern.replace(")*", ")*+").replace("(?m:$)", "(?dm:$)")
    return rule.pattern


_SPAN = "array<struct<start:int,ord:int,end:int>>"


def _no_spans() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


_BLOCK = 128    # matches of a text that are treated together


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _block_numbers(items: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))


def _block(items: Column, b: Column) -> Column:
    return F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK))


def _matches(rule: Rule) -> Column:
    return F.regexp_extract_all("text", F.lit(_search_pattern(rule)), F.lit(0))


def _spans(rule: Rule, order: int, found: str) -> Column:
    """array<struct<start, ord, end>> of the rule's matches in ``text``, of which ``found`` holds the
    strings; code points; matches that are too short are dropped."""
    pattern = _search_pattern(rule)
    lengths = F.transform(found, lambda x: F.length(x))
    gaps = F.slice(F.transform(F.split("text", pattern, -1), lambda x: F.length(x)), F.lit(1), F.size(found))
    held = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)), lambda x: F.length(x)) if rule.group else lengths
    empty = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,held:int>>)")

    def add(s, m):      # the start of a match: all that stands between the matches up to it and the matches before it
        start = s["at"] + m["0"]
        end = start + m["1"]
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), m["2"].alias("held"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    # arrays grow only within a block of matches, so the work follows their number
    zipped = F.transform(F.arrays_zip(gaps, lengths, held), lambda m: F.struct(
        m["0"].alias("0"), m["1"].alias("1"), m["2"].alias("2")))
    blocks = _let(zipped, lambda z: F.transform(_block_numbers(z), lambda b: F.aggregate(
        _block(z, b), F.struct(F.lit(0).alias("at"), empty.alias("out")), add)))

    def placed(block, offset):
        return F.transform(F.filter(block["out"], lambda m: m["held"] >= rule.least), lambda m: F.struct(
            (m["start"] + offset).alias("start"), m["ord"].alias("ord"), (m["end"] + offset).alias("end")))

    kept = _let(blocks, lambda y: F.flatten(F.transform(y, lambda x, b: _let(
        F.aggregate(F.slice(y, F.lit(1), b), F.lit(0), lambda n, e: n + e["at"]), lambda offset: placed(x, offset)))))
    return F.when(F.size(found) == 0, _no_spans()).otherwise(kept.cast(_SPAN))


def _key():
    """Names a document's id and text: rows that agree in both have the same result."""
    return F.xxhash64("doc_id", "text")


def trigram_candidates(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds): a bit for each rule whose trigram query the document's postings satisfy."""
    grams = sorted(set().union(*(g for r in rules for g in r.query)))
    if len(grams) > 62:
        raise ValueError("more than 62 trigrams: split the rules over several indexes")
    bit = {g: 1 << i for i, g in enumerate(grams)}
    low = texts.select(_key().alias("key"), ascii_lower(F.col("text")).alias("low"))
    vocabulary = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(b).cast("long").alias("b")) for g, b in bit.items()))
    postings = (low.select("key", F.explode(F.filter(F.transform(vocabulary, lambda v: F.when(F.contains("low", v["g"]), v["b"])),
                                                     lambda b: b.isNotNull())).alias("bit")))
    met = postings.groupBy("key").agg(F.bit_or("bit").alias("grams"))
    kinds = F.lit(0)
    for i, r in enumerate(rules):
        holds = F.lit(False)
        for alternative in r.query:
            mask = F.lit(sum(bit[g] for g in alternative)).cast("long")
            holds = holds | (F.col("grams").bitwiseAND(mask) == mask)
        kinds = kinds.bitwiseOR(F.when(holds, F.lit(1 << i)).otherwise(F.lit(0)))
    return met.select("key", kinds.alias("kinds")).filter("kinds <> 0")


def _with_found(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (doc_id, text without nulls, any other columns) with __found, the array of spans."""
    indexed = [r for r in rules if r.query]
    found = trigram_candidates(rows, indexed).select(F.col("key").alias("__key"), F.col("kinds").alias("__kinds"))
    joined = rows.join(found, _key() == F.col("__key"), "left")
    for order, r in enumerate(rules):
        matches = _matches(r)
        if r.query:
            own = F.coalesce(F.col("__kinds"), F.lit(0)).bitwiseAND(F.lit(1 << indexed.index(r))) != 0
            matches = F.when(own, matches).otherwise(F.expr("cast(array() as array<string>)"))
        joined = joined.withColumn(f"__m{order}", matches)
    spans = [_spans(r, i, f"__m{i}") for i, r in enumerate(rules)]
    return joined.withColumn("__found", F.sort_array(F.concat(*spans))).drop("__key", "__kinds", *(f"__m{i}" for i in range(len(rules))))


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and found: array of (start, ord, end) by start and then by rule, where ord is the
    rule's place among the base rules and ``rules`` (default: MORE_RULES); start and end count code
    points, end exclusive; per rule the matches are leftmost and do not overlap, and those that are
    too short are dropped after matching.

    Null texts count as empty and hold nothing; repeated rows and null ids stay; an empty table
    gives no row; other columns are not read."""
    rules = BASE_RULES + (MORE_RULES if rules is None else rules)
    return _with_found(whole_texts(docs, id_col, text_col), rules).withColumnRenamed("__found", "found")


def _masked(text: Column, found: Column, instead: str) -> Column:
    """``text`` with ``instead`` for the spans in ``found``, block by block: a block's own stretch of the text begins
    where the spans of the blocks before it end."""
    def one_block(spans, base, piece):
        def add(s, m):
            new = F.concat(s["out"], F.substring(piece, s["at"] - base + 1, m["start"] - s["at"]), F.lit(instead))
            return (F.when((m["start"] > s["at"]) | (s["at"] == 0), F.struct(m["end"].alias("at"), new.alias("out")))
                    .otherwise(F.struct(F.greatest(s["at"], m["end"]).alias("at"), s["out"].alias("out"))))

        return F.aggregate(spans, F.struct(base.alias("at"), F.lit("").alias("out")), add, lambda s: s["out"])

    ends = F.transform(_block_numbers(found), lambda b: F.array_max(F.transform(_block(found, b), lambda m: m["end"])))
    return _let(ends, lambda e: F.concat(
        F.array_join(F.transform(e, lambda end, b: _let(F.coalesce(F.array_max(F.slice(e, F.lit(1), b)), F.lit(0)), lambda base: _let(
            F.substring(text, base + 1, F.greatest(end - base, F.lit(0))), lambda piece: one_block(_block(found, b), base, piece)))), ""),
        F.substring(text, F.array_max(e) + 1, F.length(text))))


def mask(docs: DataFrame, instead: str, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``instead``, overlapping and touching spans as one;
    n_chars, where there is such a column, follows the new text. Other columns, null texts and texts without a
    span stay as they are."""
    rules = BASE_RULES + (MORE_RULES if rules is None else rules)
    found = _with_found(docs.withColumn("__text", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))), rules)
    masked = _masked(F.col("text"), F.col("__found"), instead)
    out = found.withColumn("__text", F.when(F.size("__found") > 0, masked).otherwise(F.col("__text")))
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("__found") > 0, F.length("__text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def _joined(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (see ``find_secrets``)."""
    kinds = [r.kind for r in BASE_RULES + MORE_RULES]
    count = lambda i: F.size(F.filter("found", lambda s: s["ord"] == i)).cast("long")
    found = find_secrets(docs).select("doc_id", "found")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(kinds[:3])),
                        F.sha2(_joined(F.filter("found", lambda s: s["ord"] < 3), kinds), 256).alias("base_sha256"),
                        _joined(F.col("found"), kinds).alias("spans"))


def oracle() -> str:
    def spans(rule, order):
        p = "'" + rule.pattern.replace("'", "''") + "'"
        own = f"SELECT doc_id, t, regexp_extract_all(t, {p}) f, regexp_extract_all(t, {p}, {rule.group}) g, string_split_regex(t, {p}) b FROM d"
        return (f"SELECT doc_id, t, {order} AS ord, '{rule.kind}' AS kind, length(g[i]) AS held, "
                f"list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) AS s, "
                f"length(f[i]) AS n, {rule.least} AS least FROM ({own}) o, unnest(range(1, len(f) + 1)) u(i)")
    every = " UNION ALL ".join(spans(r, i) for i, r in enumerate(BASE_RULES + MORE_RULES))
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT * FROM ({every}) WHERE held >= least),
a AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg({one}, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg({one}, ',' ORDER BY s, ord) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""
