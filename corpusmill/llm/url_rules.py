"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern is matched against a url's host and path, put together; hosts hold no slash, so the first one starts the
path. Lines of a rule list read like this, A-Z taken as a-z:

    text        anywhere; `*` stands for any characters, `^` for one that is no letter, digit, `_`, `-`, `.` or `%`, or the end
    |text       at the start of the host
    ||text      at the start of the host or of one of its labels
    text|       at the end of the path
    @@text      an exception: what it matches is allowed, whatever other patterns say
    ! text      a remark, as is an empty line

A site rule `host/path` fits the host and its subdomains where the path starts so, in the path's own case.

Every rule is compiled to one regular expression, whose parts between stars match in turn without going back, so that the
time is linear in the url. Its literal tokens are the runs of a-z and 0-9 that every match must hold whole, between
characters that are neither. Each rule is filed under the one that fewest urls hold; the tokens of a url fetch its candidate
rules, and only those run. Rules without such a token are candidates for every url.

The rule set is the caller's and goes to every task: at most MAX_RULES of them, more are an error. The token counts cover all
urls. Null url or one without `://`: empty host and path, no rule, the default verdict. Very long urls are judged whole.
Repeated rows stay. Of the rules that match, the one of the highest rank wins, then the longest name, then the least name.
An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

MAX_RULES = 200_000
SITE, EXCEPTION, PATTERN = 2, 1, 0  # ranks
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)
_TOKEN = re.compile("[a-z0-9]+")
_SEPARATOR = r"(?:[^a-z0-9_.%-]|\Z)"


@dataclass(frozen=True)
class Rule:
    """regex is matched from the start of the text, lower case (A-Z) if folded; plain says the same without atomic groups."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...] = ()
    rank: int = PATTERN
    folded: bool = True
    plain: str = ""


def site_rule(site: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the path starts so."""
    host, slash, path = site.partition("/")
    host = host.translate(_ASCII_LOWER)
    literal = host + slash + path
    regex = rf"\A(?:[^/]*\.)?{re.escape(literal)}"
    return Rule(site, verdict, regex, whole_tokens(literal, before=True, after=False), SITE, False, regex)


def whole_tokens(literal: str, before: bool, after: bool) -> tuple[str, ...]:
    """Tokens of a literal; before, after: whether no token of a match can reach over its start or its end."""
    literal = literal.translate(_ASCII_LOWER)
    return tuple(m[0] for m in _TOKEN.finditer(literal) if (before or m.start()) and (after or m.end() < len(literal)))


def pattern_rule(line: str) -> Rule:
    """One line of a rule list; see the module's docstring."""
    text = line.strip().translate(_ASCII_LOWER)
    exception = text.startswith("@@")
    body = text[2:] if exception else text
    label, body = body.startswith("||"), body.removeprefix("||")
    start = not label and body.startswith("|")
    body = body[start:]
    end = body.endswith("|")
    body = body[: len(body) - end]
    parts = body.split("*")
    if not any(parts):
        raise ValueError(f"a pattern without a character to look for: {line!r}")
    tokens: list[str] = []
    for i, part in enumerate(parts):
        tokens += whole_tokens(part, before=i == 0 and (label or start), after=i == len(parts) - 1 and end)

    def regex(atomic: bool) -> str:
        out = r"\A"
        for i, part in enumerate(parts):
            own = "".join(_SEPARATOR if c == "^" else re.escape(c) for c in part)
            lead = "(?:[^/]*?\\.)??" if i == 0 and label else "" if i == 0 and start else ".*?"
            last = i == len(parts) - 1 and end
            # the first place where a part fits leaves most to the parts after it, so no other need be tried
            out += f"{lead}{own}" + r"\Z" * last if last or not atomic else f"(?>{lead}{own})"
        return out

    return Rule(text, "allow" if exception else "block", regex(True), tuple(tokens), EXCEPTION if exception else PATTERN, True, regex(False))


def pattern_rules(lines: Iterable[str]) -> list[Rule]:
    """The rules of a list; remarks and empty lines are skipped."""
    return [pattern_rule(x) for x in lines if x.strip() and not x.lstrip().startswith("!")]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): see the package's contract for op9."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_ASCII_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def token_counts(pages: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many urls each wanted token occurs; at most as many rows as wanted come back."""
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))
    asked = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")  # bounded by the rules
    found = pages.select(F.explode(words).alias("token")).join(F.broadcast(asked), "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


class Index:
    def __init__(self, rules: list[Rule], counts: dict[str, int]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.by_token: dict[str, list[tuple]] = {}
        self.always: list[tuple] = []
        for rule in rules:
            entry = ((-rule.rank, -len(rule.name), rule.name), rule, re.compile(rule.regex, re.DOTALL))
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, text: str) -> list[tuple]:
        """The rules that may match; text: host and path in lower case."""
        found = list(self.always)
        for token in set(_TOKEN.findall(text)):
            found += self.by_token.get(token, ())
        return found

    def best(self, host: str, path: str) -> Rule | None:
        text = host + path
        folded = text.translate(_ASCII_LOWER)
        hits = [entry for entry in self.candidates(folded) if entry[2].match(folded if entry[1].folded else text)]
        return min(hits, key=lambda e: e[0])[1] if hits else None


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule (name of the rule that decided, or null), rank of it, verdict."""
    bounded(pages.sparkSession)
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = token_counts(pages, wanted) if wanted else {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule = index.best(host, path) if host or path else None
                rows.append((host, path, rule.name if rule else None, rule.rank if rule else None, rule.verdict if rule else default))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True))], ["page_id", "url", "host", "path", "rule", "rank", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(work, "page_id long, url string, host string, path string, rule string, rank int, verdict string")
