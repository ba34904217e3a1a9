"""Secret scans behind a trigram index.

Each rule's regular expression is parsed into a Boolean query over trigrams: literal runs
give conjunctions, alternatives give disjunctions, and what can be left out gives nothing.
Texts are read about a megabyte at a time: every trigram of their bytes becomes a number once,
one table look-up each says which of the rules' trigrams it is, and what is found makes the
postings (which texts hold which trigram). A rule's query intersects and unites postings, and
only the candidates run its expression, so the cost of the index does not grow with the rules.
Rules without a mandatory trigram scan everything. A-Z count as a-z in the index, and a letter
that a rule reads in other cases too is no part of a query, so candidates are never too few.

Edge cases: null text counts as empty and holds no secret; repeated rows stay; very long
texts are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lean, portions, table


@dataclass(frozen=True)
class SecretRule:
    """least: code points that group `group` must have; base: one of the three kinds every report counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = 0
    base: bool = False


#: From the header to the END line; without one through the header fields and the lines of base64, the last of which may be short.
_BREAK = r"""(?:[\s>#*|"',]|\\[rn])"""
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:\r?\n[A-Z][A-Za-z0-9-]*:\x20[^\r\n]*)*(?:(?:{_BREAK}+[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:{_BREAK}+=?[A-Za-z0-9+/]+(?:={{1,2}}|(?=[\x20\t]*(?:[\r\n]|\\[rn]|\Z))))?)?)"
)
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.IGNORECASE | re.ASCII, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, 0, True),
    SecretRule("hex", r"[0-9a-f]+", 0, 24, 0, True),
    SecretRule("private_key", PRIVATE_KEY),
    # from the left end of a run only, so that a run is read once however often it restarts
    SecretRule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    SecretRule("url_login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]{3,}@"),
)
# A query is True (no condition), ("tri", trigram), ("and", ...) or ("or", ...).


def conj(parts):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *dict.fromkeys(parts))


def disj(parts):
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", *dict.fromkeys(parts))


def of_text(s: str):
    b = s.encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
    return conj([("tri", b[i : i + 3]) for i in range(len(b) - 2)])


#: A-Z as a-z, all other bytes as they are.
LOWER_BYTES = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
MAX_STRINGS = 16


def trigram_query(pattern: str, flags: int = 0):
    """Boolean trigram query that every text with a match satisfies."""
    any_case = flags & re.IGNORECASE

    def sure(c: int) -> bool:
        """Is the letter itself, or A-Z for a-z, all that it can match?"""
        return not any_case or (c < 128 and (bool(flags & re.ASCII) or chr(c) not in "iIkKsS"))

    def walk(items):
        """(exact strings that the items can spell, or None; query)."""
        runs: list[list[str]] = [[""]]
        found = []

        def close():
            found.append(disj([of_text(s) for s in runs[-1]]))
            runs.append([""])

        for op, arg in items:
            exact = None
            query = True
            if op is C.LITERAL and sure(arg):
                exact = [chr(arg)]
            elif op is C.IN and all(k is C.LITERAL and sure(v) for k, v in arg):
                exact = [chr(v) for _, v in arg]
            elif op is C.SUBPATTERN:
                exact, query = walk(arg[3])
            elif op is C.BRANCH:
                each = [walk(x) for x in arg[1]]
                exact = [s for e, _ in each for s in e] if all(e is not None for e, _ in each) else None
                query = disj([q if e is None else disj([of_text(s) for s in e]) for e, q in each])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, body = arg
                e, q = walk(body)
                if e is not None and (low, high) == (0, 1):
                    exact = ["", *e]
                elif e is not None and low == high == 1:
                    exact = e
                elif low:
                    query = q if e is None else disj([of_text(s) for s in e])
            elif op is C.AT:
                exact = [""]
            if exact is not None:
                exact = list(dict.fromkeys(exact))
                if len(runs[-1]) * len(exact) <= MAX_STRINGS:
                    runs[-1] = [a + b for a in runs[-1] for b in exact]
                    continue
                query = disj([of_text(s) for s in exact])
            close()
            found.append(query)
        whole = runs[-1] if len(runs) == 1 else None
        if whole is None:
            close()
        return whole, conj(found)

    exact, query = walk(_parser.parse(pattern, flags))
    return query if exact is None else disj([of_text(s) for s in exact])


def trigrams_in(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_in(q) for q in query[1:]))


def candidates(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Which of n texts satisfy the query."""
    if query is True:
        return np.ones(n, bool)
    if query[0] == "tri":
        return postings[query[1]]
    parts = [candidates(q, postings, n) for q in query[1:]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def numbered(trigrams: list[bytes]) -> np.ndarray:
    """For each of all trigrams of bytes its number in the list, counted from 1, or 0."""
    place = np.zeros(1 << 24, np.uint16 if len(trigrams) < 1 << 16 else np.uint32)
    for k, g in enumerate(trigrams):
        place[g[0] << 16 | g[1] << 8 | g[2]] = k + 1
    return place


def postings_of(texts: list[str], place: np.ndarray, n: int) -> np.ndarray:
    """(n, texts): which texts hold each trigram."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    c = np.frombuffer(b"".join(parts).translate(LOWER_BYTES), np.uint8)
    out = np.zeros((n, len(texts)), bool)
    for a in range(0, len(c), 1 << 20):
        x = c[a : a + (1 << 20) + 2].astype(np.uint32)
        number = place[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
        at = np.flatnonzero(number)
        owner = np.searchsorted(ends, at + a, side="right")
        whole = at + a + 2 < ends[owner]  # not across two texts
        out[number[at[whole]].astype(np.int64) - 1, owner[whole]] = True
    return out


def matches(rule: SecretRule, compiled: re.Pattern, text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), rule.kind) for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def compiled(rule: SecretRule) -> re.Pattern:
    """A run shorter than `least` can't match in a rule that is one repeated class, so the bound goes into the expression."""
    pattern = rule.pattern
    if rule.least and rule.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", pattern):
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    return re.compile(pattern, rule.flags)


def finder(text_col: str, rules: tuple[SecretRule, ...], out_col: str):
    """The function of a task that adds find_secrets' column to batches."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    needed = sorted(set().union(*(trigrams_in(q) for q in queries)))
    order = {r.kind: i for i, r in enumerate(rules)}

    def run(batches):
        ready = [compiled(r) for r in rules]
        place = numbered(needed)
        for b in batches:
            spans: list[list] = []
            for texts in portions(b.column(text_col).to_pylist()):
                texts = [t or "" for t in texts]
                held = dict(zip(needed, postings_of(texts, place, len(needed))))
                found: list[list] = [[] for _ in texts]
                for rule, regex, query in zip(rules, ready, queries):
                    for i in np.flatnonzero(candidates(query, held, len(texts))).tolist():
                        found[i] += matches(rule, regex, texts[i])
                spans += [[{"kind": k, "start": s, "end": e} for s, e, k in sorted(x, key=lambda m: (m[0], order[m[2]]))] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [*b.schema.names, out_col])

    return run


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[SecretRule, ...] = RULES, out_col: str = "secrets") -> DataFrame:
    """The rows with a column `out_col` (an older one is replaced): array of (kind, start, end) in code points, by start, then kind as listed."""
    docs = docs.drop(out_col)
    schema = docs.select("*", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>").alias(out_col)).schema
    return docs.mapInArrow(lean(finder(text_col, rules, out_col)), schema)


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = "filter(secrets, s -> s.kind in ('assign', 'access', 'hex'))"
    count = "cast(size(filter(secrets, s -> s.kind = '{0}')) as bigint) as n_{0}"
    return found.selectExpr("doc_id", *(count.format(k) for k in ("assign", "access", "hex")), f"sha2({joined(base)}, 256) as base_sha256", f"{joined('secrets')} as spans")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every found span of the text replaced; overlapping spans give one mark. Found and replaced in one worker."""
    names, held = docs.columns, free_name(docs, "found_secrets")
    find = finder(text_col, RULES, held)

    def run(batches):
        for b in find(batches):
            out = []
            for text, spans in zip(b.column(text_col).to_pylist(), b.column(held).to_pylist()):
                if spans:
                    parts, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], mark]
                        at = max(at, s["end"])
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text_col else b.column(n) for n in names], names)

    return docs.mapInArrow(lean(run), docs.schema)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()


def _in_sql(rule: SecretRule, order: int) -> str:
    """Spans of one rule: the pieces between matches and the matches themselves give the offsets."""
    pattern = rule.pattern
    if rule.kind == "private_key":
        return _keys_in_sql(order)
    if rule.flags & re.IGNORECASE:  # letters of the first group in either case, and no others
        head, rest = pattern.split(")", 1)
        pattern = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head) + ")" + rest
    group = rule.group
    if pattern.startswith("(?<!"):  # the letter before is taken along, and left out of the span
        behind, rest = pattern[len("(?<!") :].split(")", 1)
        pattern, group = f"(?:^|{behind.replace('[', '[^', 1)})({rest})", 1
    quoted = pattern.replace("'", "''")
    inner = "(size - len(held[i]))" if group != rule.group else "0"
    return f"""SELECT row_id, '{rule.kind}' AS kind, {order} AS k, s + {inner} AS s, size - {inner} AS size FROM (SELECT *, list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS s, len(found[i]) AS size
  FROM (SELECT row_id, pieces, found, held, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT row_id, string_split_regex(t, '{quoted}') AS pieces, regexp_extract_all(t, '{quoted}') AS found, regexp_extract_all(t, '{quoted}', {group}) AS held FROM d)))
  WHERE len(held[i]) >= {rule.least}"""


def _keys_in_sql(order: int) -> str:
    """Private keys: the text from one BEGIN to the next holds at most one, so the rule's look-ahead is not needed; its other look-ahead ends a match that is captured."""
    head, block = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----", _BREAK
    fields = r"(?:\r?\n[A-Z][A-Za-z0-9-]*:\x20[^\r\n]*)*"
    lines = rf"(?:{block}+[A-Za-z0-9+/]{{16,}}={{0,2}})+"
    last = rf"{block}+=?[A-Za-z0-9+/]+"
    ways = [rf"^({head}{fields}(?:{lines})?)", rf"^({head}{fields}{lines}{last}={{1,2}})", rf"^({head}{fields}{lines}{last})[\x20\t]*(?:[\r\n]|\\[rn]|\z)"]
    quote = lambda p: p.replace("'", "''")
    whole = quote(rf"^({head}(?s:.*?)-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----)")
    longest = ", ".join(f"len(regexp_extract(part, '{quote(w)}', 1))" for w in ways)
    return f"""SELECT row_id, 'private_key' AS kind, {order} AS k, s, size FROM (SELECT row_id, s, coalesce(nullif(len(regexp_extract(part, '{whole}', 1)), 0), greatest({longest})) AS size FROM (
    SELECT row_id, '-----BEGIN ' || pieces[i] AS part, list_sum(list_transform(pieces[1:i - 1], lambda x: len(x))) + 11 * (i - 2) AS s FROM (SELECT row_id, pieces, unnest(range(2, len(pieces) + 1)) AS i FROM (SELECT row_id, string_split(t, '-----BEGIN ') AS pieces FROM d)))) WHERE size > 0"""


def _count_sql(kind: str) -> str:
    return f"count(*) FILTER (kind = '{kind}') AS n_{kind}"


OP10_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_in_sql(r, i) for i, r in enumerate(RULES))}),
g AS (SELECT row_id, {", ".join(_count_sql(r.kind) for r in RULES if r.base)},
    string_agg(kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT, ',' ORDER BY s, k) FILTER (k < {sum(r.base for r in RULES)}) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT, ',' ORDER BY s, k) AS spans FROM m GROUP BY row_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_id)
"""
