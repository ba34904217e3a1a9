"""URL filters: rules indexed by their rarest literal token.

Rules are patterns over host and path: plain text, `*` for anything, `^` for a separator or the
end, `||` at the beginning for the start of the host or of one of its labels. Every rule
names literal tokens that any URL it fits must contain as a whole. The token that the
corpus holds least often becomes the rule's key; a URL's own tokens then fetch the
candidate rules, and only those run their regular expressions (the rarest token of a long
pattern says little about the rest, so most candidates can still be rejected). Rules without
a whole token are tried on every URL. Rules are judged in blocks of ``BLOCK_RULES``, whose index
travels in the task closure; pages are never shuffled.

Edge cases: a null URL, or one without ``://``, has empty host and path, no rule and the
method's verdict (allow); an empty table gives an empty result; repeated rows stay; extra
columns are ignored; among equally long base rules the one listed first wins, and of several
patterns the one listed first is named.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

BLOCK_RULES = 20_000
TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class UrlRule:
    """name: shown in the result; site: host/path rule (else a pattern rule); tokens: whole tokens that any fitting URL holds."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(verdict: str, name: str) -> UrlRule:
    """`example.net/en/` fits that host and all its subdomains if the path starts with /en/."""
    host, _, path = name.partition("/")
    whole = f"{host}/{path}"
    last = 0 if re.search(r"[a-zA-Z0-9]$", whole) else None  # an open last token may be cut
    tokens = TOKEN.findall(whole.lower())
    tokens = tokens[:-1] if last == 0 and path else tokens
    return UrlRule(name, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(tokens), True)


SEPARATOR = "[^a-z0-9_.%-]"


def pattern_rule(text: str, verdict: str = "block") -> UrlRule:
    """A rule from a pattern in lower case, such as `||ads.` or `/track/*.gif^`."""
    body = text.removeprefix("||")
    begin = r"(?:\A|\A[^/]*\.)" if body != text else ""
    pattern = begin + "".join(".*" if c == "*" else rf"(?:{SEPARATOR}|\Z)" if c == "^" else re.escape(c) for c in body)
    # a token is whole if the pattern itself bounds it
    tokens = [m[0] for m in TOKEN.finditer(body) if (m.start() > 0 or begin) and body[m.start() - 1 : m.start()] != "*" and body[m.end() : m.end() + 1] not in ("", "*")]
    return UrlRule(text, verdict, pattern, tuple(tokens))


SITE_RULES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
)
#: Adverts, trackers, accounts, shops' tills, betting, pills, adult pages and spam.
BLOCK_PATTERNS = (
    "||ads.",
    "||ads-*.",
    "||adserver*.",
    "/ads/*",
    "||track.",
    "||tracker*.",
    "/track/*.gif^",
    "||casino-*.",
    "||*-casino.",
    "||free-bets.",
    "||cheap-pills.",
    "/viagra-*",
    "||xxx.",
    "||adult-*.",
    "||spam-*.",
    "/porn/",
    "/login^",
    "/signup^",
    "/cart/*/checkout^",
    "/wp-login.php^",
    "/tag/*/page/",
)
DEFAULT_RULES = SITE_RULES + tuple(map(pattern_rule, BLOCK_PATTERNS))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(pages: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens, over all rows; one number per token comes back."""
    lower = ascii_lower(F.concat(host_of(F.col(url_col)), path_of(F.col(url_col))))
    held = F.array_distinct(F.filter(F.split(lower, "[^a-z0-9]+"), lambda t: t.isin(tokens)))
    rows = pages.select(F.explode(held).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = DEFAULT_RULES, block_rules: int = BLOCK_RULES) -> DataFrame:
    """(id, host, path, rule, verdict, pattern_rule, n_candidates, n_rejected) of every row."""
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("pattern_rule"), F.lit(0).cast("long").alias("n_candidates"), F.lit(0).cast("long").alias("n_rejected"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern_rule string, n_candidates long, n_rejected long"
    for k in range(0, len(rules), block_rules):
        rows = rows.mapInArrow(_judge(pages, url_col, rules[k : k + block_rules]), schema)
    return rows


def _judge(pages: DataFrame, url_col: str, rules: tuple[UrlRule, ...]):
    """Work of one block of rules on rows that bear the outcome of those before."""
    names = sorted({t for r in rules for t in r.tokens})
    seen = token_counts(pages, url_col, names)
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for i, r in enumerate(rules):
        key = min(r.tokens, key=lambda t: (seen.get(t, 0), t), default=None)
        (index.setdefault(key, []) if key is not None else always).append(i)

    def judge(batches):
        compiled: dict[int, re.Pattern] = {}
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names[1:]}
            for n, (host, path) in enumerate(zip(cols["host"], cols["path"])):
                whole = host + path
                low = whole.translate(_LOWER)
                cand = {i for t in set(TOKEN.findall(low)) for i in index.get(t, ())}
                cand.update(always)
                for i in sorted(cand):
                    r = rules[i]
                    if i not in compiled:
                        compiled[i] = re.compile(r.pattern, re.S)
                    if not compiled[i].search(whole if r.site else low):
                        cols["n_rejected"][n] += 1
                    elif r.site:
                        if cols["rule"][n] is None or len(r.name) > len(cols["rule"][n]):
                            cols["rule"][n], cols["verdict"][n] = r.name, r.verdict
                    elif cols["pattern_rule"][n] is None:
                        cols["pattern_rule"][n] = r.name
                        if cols["rule"][n] is None:
                            cols["verdict"][n] = r.verdict
                cols["n_candidates"][n] += len(cand)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, b.schema.field(c).type) for c, v in cols.items())], b.schema.names)

    return judge


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The patterns again, as one expression for the SQL's engine.
_PATTERNS = "|".join(f"(?:{r.pattern})" for r in DEFAULT_RULES if not r.site).replace(r"\A", "^").replace(r"\Z", "$")
OP3_SQL = rf"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?s){_PATTERNS}') THEN 'block'
       ELSE 'allow' END AS verdict
FROM ruled
"""
