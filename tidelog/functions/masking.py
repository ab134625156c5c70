"""Masking: what varies in a log line becomes a typed placeholder.

`mask_column` runs `mask_line`, the whole rule, over Arrow batches. `masked_text` is an
expression for lines without parenthesised asides, unit words or component prefixes;
`with_masked_text` is the same in Arrow batches, and what the SQL shapes group by.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .severity import ALL_WORDS

_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: What a token is, tested in this order. (placeholder, pattern, least bytes)
CLASSES = [
    ("<STR>", r"^(\"[\s\S]*\"|'[\s\S]*')$", 2),
    ("<UUID>", r"^[{}]*[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}[{}]*$", 0),
    ("<TIME>", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0),
    ("<TIME>", r"^[0-9]{1,2}([.][^:]*)?:[0-9]{1,2}([.][^:]*)?:[0-9]{1,2}([.][^:]*)?$", 0),
    ("<IP>", rf"^({_OCTET}[.]){{3}}{_OCTET}(:[0-9]+)?$", 0),
    ("<HEX>", r"^(0[xX])?[0-9A-Fa-f]{8,}$", 16),
    ("<NUM>", r"^[-+]?([0-9][0-9mshdBKMG]*([.][0-9mshdBKMG]*)?|[.][0-9][0-9mshdBKMG]*)$", 0),
    ("<HEX>", r"^(0[xX])?[0-9A-Fa-f]{8,}$", 0),
    ("<PATH>", r"^(/[\s\S]+|[.]/[\s\S]*|[.][.]/[\s\S]*)$", 0),
    ("<VAR>", r"[0-9]", 0),
]

#: Words that may follow a value.
UNITS = frozenset("sec secs ms msec s m h KB MB GB TB kb mb gb bytes".split())
ASIDE_WORDS = 4
WILD = "<*>"
_anchored = [(rf"(?=[\s\S]{{{least},}})" if least else "") + (p.removesuffix("$") + r"\Z" if p.endswith("$") else p if p[0] == "^" else r"[\s\S]*" + p) for _, p, least in CLASSES]
#: All classes in one pattern: the first that matches names the token.
_any = re.compile("|".join(f"(?P<c{i}>{p})" for i, p in enumerate(_anchored)))
_names = {f"c{i}": name for i, (name, _, _) in enumerate(CLASSES)}
_tail = re.compile(r"[^A-Za-z0-9]+\Z")
_UNIT_STARTS = frozenset(u[0] for u in UNITS)
_component = re.compile(r"\[[A-Za-z0-9._:/-]+\]")
_digit = re.compile("[0-9]")


@lru_cache(maxsize=65_536)
def classify(token: str) -> str:
    """The placeholder of a token, '' if it is static."""
    m = _any.match(token) if token else None
    return _names[m.lastgroup] if m else ""


@lru_cache(maxsize=65_536)
def _one(word: str, leading: bool) -> tuple[str, str]:
    """Masked form and parameter of a word."""
    if leading and _component.fullmatch(word) and word[1:-1].lower() not in ALL_WORDS:
        return "<COMP>", word
    core = word.rstrip(",;.)]}:") or word
    tail = word[len(core) :]
    key, eq, value = core.partition("=")
    if eq and key and value and not _digit.search(key) and '"' not in key:
        kind = classify(value)
        return (f"{key}={kind}{tail}" if kind else core + tail), value
    kind = classify(core)
    return (kind + tail if kind else word), core


def is_placeholder(token: str) -> bool:
    return "<" in token and ">" in token


def mask_line(line: str) -> tuple[list[str], list[str]]:
    """Masked tokens and the parameter at each. An aside in parentheses of up to four
    words that holds a digit goes, as does a unit word after a placeholder."""
    words, tokens, raw, at = line.split(), [], [], 0
    while at < len(words):
        word = words[at]
        if word[0] == "(" and not word.startswith("()"):
            end = next((i for i in range(at, min(len(words), at + ASIDE_WORDS)) if words[i][-1] == ")"), None)
            if end is not None and _digit.search(" ".join(words[at : end + 1])):
                at = end + 1
                continue
        if tokens and word[0] in _UNIT_STARTS and is_placeholder(tokens[-1]) and _tail.sub("", word) in UNITS:
            at += 1
            continue
        token, value = _one(word, at < 2)
        tokens.append(token)
        raw.append(value)
        at += 1
    return tokens, raw


def mask_column(df: DataFrame, body: str, tokens: str = "tokens", raw: str = "raw") -> DataFrame:
    """Adds the masked tokens and the parameter candidates of a text column."""
    ship(df.sparkSession)

    def run(bodies: pd.Series) -> pd.DataFrame:
        done = [mask_line(b) if b else ([], []) for b in bodies]
        return pd.DataFrame({"tokens": [d[0] for d in done], "raw": [d[1] for d in done]})

    masked = F.pandas_udf(run, "tokens array<string>, raw array<string>")
    return df.withColumn("__m", masked(body)).withColumn(tokens, F.col("__m.tokens")).withColumn(raw, F.col("__m.raw")).drop("__m")


#: Between tokens in a masked line's key; white space, so no token holds it.
MARK = "\x1f"


def _keys(bodies: pd.Series) -> pd.Series:
    return pd.Series([MARK.join(mask_line(b)[0]) if b else "" for b in bodies], dtype=object)


def _keys_and_values(bodies: pd.Series) -> pd.DataFrame:
    done = [mask_line(b) if b else ([], []) for b in bodies]
    return pd.DataFrame({"key": [MARK.join(d[0]) for d in done], "raw": [MARK.join(d[1]) for d in done]})


def mask_key(df: DataFrame, body: str, key: str, raw: str | None = None) -> DataFrame:
    """Adds the masked tokens as one text (empty without tokens) and, if asked for, the
    parameter candidates as another: texts pass through Arrow faster than lists."""
    ship(df.sparkSession)
    if raw is None:
        return df.withColumn(key, F.pandas_udf(_keys, "string")(body))
    masked = F.pandas_udf(_keys_and_values, "key string, raw string")
    return df.withColumn("__m", masked(body)).withColumn(key, F.col("__m.key")).withColumn(raw, F.col("__m.raw")).drop("__m")


def split_key(key: Column) -> Column:
    """The tokens of a key."""
    return F.when(key != "", F.split(key, MARK)).otherwise(F.array().cast("array<string>"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: an expression that is named twice is
    otherwise computed twice, in every place that names it."""
    return F.get(F.transform(F.array(value), use), 0)


#: A token without a match is static: what any class but the last needs, and digits.
_MAY_VARY = r"[0-9\"'/]|^[.]|^(0[xX])?[A-Fa-f]{8,}$|^[{}]*[A-Fa-f]{8}-"


def classify_expr(token: Column) -> Column:
    """classify() as an expression; '' for static tokens."""
    out = F.when(~token.rlike(_MAY_VARY), "")
    for name, pattern, least in CLASSES:
        test = token.rlike(pattern)
        out = out.when((F.octet_length(token) >= least) & test if least else test, name)
    return out.otherwise("")


def words_of(body: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")


def masked_word(word: Column) -> Column:
    """The masked form of a word after the first two, asides and units apart."""

    def with_core(core: Column) -> Column:
        eq = F.instr(core, "=")
        key = F.substr(core, F.lit(1), eq - 1)
        pair = (eq > 1) & (eq < F.length(core)) & ~key.rlike('[0-9"]')
        return let(F.when(pair, eq).otherwise(0), lambda at: let(F.substr(core, at + 1), lambda v: let(classify_expr(v), lambda kind: placed(core, at, kind))))

    def placed(core: Column, at: Column, kind: Column) -> Column:
        return F.when(kind == "", word).otherwise(F.concat(F.substr(core, F.lit(1), at), kind, F.substr(word, F.length(core) + 1)))

    return let(F.regexp_extract(word, r"^([\s\S]*?)[,;.)\]}:]*$", 1), lambda bare: let(F.when(bare == "", word).otherwise(bare), with_core))


def masked_text(body: Column) -> Column:
    """The template text of a line without asides, unit words or component prefixes: an
    order-free approximation of a mined template, not the miner's own text."""
    return F.array_join(F.transform(words_of(body), masked_word), " ")


def _masked_batch(bodies: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else " ".join([_one(w, False)[0] for w in b.split()]) for b in bodies], dtype=object)


def with_masked_text(df: DataFrame, body: str = "body", name: str = "template") -> DataFrame:
    """Adds masked_text() of a column in Arrow batches, where words that come again are
    looked up: several times as fast as the interpreted expression."""
    ship(df.sparkSession)
    return df.withColumn(name, F.pandas_udf(_masked_batch, "string")(body))


_number = re.compile(r"-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z")


def numbers(body: str) -> list[float]:
    """The numbers of a line in order, from its first 64 words: what follows the last
    '=', without brackets, quotes and a unit of letters or %."""
    out = []
    for word in body.split()[:64]:
        value = word.rpartition("=")[2].lstrip("([\"'").rstrip(")],;.\"'")
        digits = re.sub(r"[A-Za-z%]+\Z", "", value)
        if digits and (digits[0] in "0123456789-") and _number.match(digits):
            v = float(digits)
            if v not in (float("inf"), float("-inf")):
                out.append(v)
    return out


def numbers_expr(body: Column) -> Column:
    """numbers() as an expression."""

    def one(w: Column) -> Column:
        value = F.substring_index(w, "=", -1)
        value = F.regexp_replace(F.regexp_replace(value, r"^[(\[\"']+", ""), r"[)\],;.\"']+$", "")
        digits = F.regexp_replace(value, "[A-Za-z%]+$", "")
        return F.when(digits.rlike(r"^(-?[0-9]+[.]?[0-9]*|-[.][0-9]+)([eE][+-]?[0-9]+)?$"), digits.try_cast("double"))

    return F.filter(F.transform(F.slice(words_of(body), 1, 64), one), lambda v: v.isNotNull())
