"""Verdicts on URLs by pattern rules that are indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import materialize
from .common import arrow_schema, batches

#: Largest index, in bytes of rule text, that is sent to the tasks; larger rule sets are joined.
MAX_INDEX_BYTES = 32 << 20

_SPLIT = "[^0-9a-z]+"


@dataclass(frozen=True)
class Rule:
    """A pattern `host/path` with its verdict. It fits the host and its subdomains if the path starts with `/path`.

    `*` in either part stands for any characters, in the host for none but
    those of one host. A pattern without a host (`/path`) fits every host.
    """

    pattern: str
    verdict: str

    @property
    def regex(self) -> str:
        """The pattern on `host/path` text, from its start."""
        host, _, path = self.pattern.partition("/")
        inside = "[^/]*".join(map(re.escape, host.lower().split("*")))
        return ("^(?:[^/]*\\.)?" + inside if host else "^[^/]*") + "/" + ".*".join(map(re.escape, path.split("*")))

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that are whole tokens of every text that fits: those with a separator on both sides.

        A token beside `*`, or at the end of the path, may be a part of a longer one.
        """
        host, _, path = self.pattern.partition("/")
        text = (f".{host.lower()}" if host else "") + "/" + path.translate(_LOWER)
        return [m[0] for m in re.finditer(r"[0-9a-z]+", text)
                if m.end() < len(text) and text[m.end()] != "*" and text[m.start() - 1] != "*"]

    @property
    def rank(self) -> tuple:
        """Of the rules that fit, the longest pattern wins; ties go to the longer host, then to the smaller text."""
        return -len(self.pattern), -len(self.pattern.partition("/")[0]), self.pattern


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case) and path (then up to `?`, `#` or the end).

    Both are empty for a null url and one without `://`.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def url_tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits in lower case."""
    return F.array_distinct(F.array_remove(F.split(lower_ascii(text), _SPLIT), ""))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many rows of `(text)` each token of the rules occurs, over all rows; at most one count per rule token."""
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    found = urls.select(F.explode(url_tokens(F.col("text"))).alias("token")).groupBy("token").count()
    return dict(found.join(wanted, "token", "left_semi").toLocalIterator())


def index_of(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token (the smallest of equally rare ones), and those without a token, which always run."""
    index: dict[str, list[Rule]] = {}
    always = []
    for rule in sorted(set(rules), key=lambda r: r.rank):
        if tokens := rule.tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            always.append(rule)
    return index, always


def judge(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", keep: tuple[str, ...] = (),
          max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """`(*keep, host, path, rule, verdict)` for every row: the longest rule that fits, else null and `default`.

    The tokens of a URL fetch the rules that are indexed under them, and only
    these run their regular expressions. An index up to `max_index_bytes` goes
    to all tasks, and each row is judged in its task without a shuffle; a larger
    one is joined with the tokens of the distinct URLs. Null urls and those
    without `://` have an empty host and path, which fit no rule. Repeated rows
    are judged alike; columns of `df` other than `keep` are not read.
    """
    host, path = host_and_path(F.col(url_col))
    parts = df.select(*keep, host.alias("_host"), path.alias("_path"))
    texts = parts.select(F.concat("_host", "_path").alias("text"))
    index, always = index_of(rules, token_counts(texts, rules))
    # a text without a host fits no rule, not even one for every host
    size = sum(len(r.pattern) + 100 for r in rules)
    judged = _sent(parts, index, always, keep) if size <= max_index_bytes else _joined(parts, index, always)
    by_rule = F.coalesce("verdict", F.lit(default))
    return judged.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", by_rule.alias("verdict"))


def _sent(parts: DataFrame, index: dict[str, list[Rule]], always: list[Rule], keep: tuple[str, ...]) -> DataFrame:
    schema = StructType([*parts.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    out = arrow_schema(schema)
    shared = parts.sparkSession.sparkContext.broadcast(
        ({t: [(r.rank, r.regex, r.pattern, r.verdict) for r in rs] for t, rs in index.items()},
         [(r.rank, r.regex, r.pattern, r.verdict) for r in always]))

    def rows(source) -> Iterator[tuple]:
        compiled: dict[str, re.Pattern] = {}
        index, always = shared.value
        split = re.compile(_SPLIT).split

        def fits(regex: str, text: str) -> bool:
            if regex not in compiled:
                compiled[regex] = re.compile(regex, re.DOTALL)
            return compiled[regex].match(text) is not None

        for batch in source:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                host, path = row[-2:]
                text, best = host + path, None
                if host:
                    candidates = [r for t in set(split(text.translate(_LOWER))) for r in index.get(t, ())] + always
                    best = min((r for r in candidates if fits(r[1], text)), default=None)
                yield *row, *(best[2:] if best else (None, None))

    return parts.mapInArrow(lambda s: batches(out, rows(s), lambda r: 300), schema)


def _joined(parts: DataFrame, index: dict[str, list[Rule]], always: list[Rule]) -> DataFrame:
    """The same by joins: distinct texts, their tokens, the rules under these, and the best rule back to all rows."""
    spark = parts.sparkSession
    held = [(t, *r.rank[:2], r.regex, r.pattern, r.verdict) for t, rs in index.items() for r in rs]
    held += [("", *r.rank[:2], r.regex, r.pattern, r.verdict) for r in always]
    table = spark.createDataFrame(held, "token string, length int, host_length int, regex string, rule string, verdict string")
    texts = materialize(parts.where("_host <> ''").select("_host", "_path").distinct(), "urls")
    text = F.concat("_host", "_path")
    tokens = texts.select("*", F.explode(F.array_append(url_tokens(text), F.lit(""))).alias("token"))
    fitting = tokens.join(table, "token").where(
        F.regexp_like(F.concat("_host", "_path"), F.concat(F.lit("(?s)"), F.col("regex"))))
    best = fitting.groupBy("_host", "_path").agg(F.min(F.struct("length", "host_length", "rule", "verdict")).alias("best"))
    return parts.join(best, ["_host", "_path"], "left").select(*parts.columns, "best.rule", "best.verdict")
