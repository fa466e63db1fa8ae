"""Masking of secrets in text and in maps."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .text import strip

# The mask, and patterns with their replacements, applied in this order (Java syntax:
# blanks, word edges and letter case by Unicode; four separators count as blanks too).
MASK = "[REDACTED]"
SHORTEST_LITERAL = 8
_W = r"\s\x1C-\x1F"
RULES = [
    (r"\bsk-ant-[A-Za-z0-9_\-]{8,}", MASK),
    (r"\bsk-(?:proj-|svcacct-|admin-)?[A-Za-z0-9_\-]{16,}", MASK),
    (r"\bAIza[A-Za-z0-9_\-]{30,}", MASK),
    (r"\bGOCSPX-[A-Za-z0-9_\-]{16,}", MASK),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}", MASK),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", MASK),
    (r"\bhf_[A-Za-z0-9]{16,}", MASK),
    (r"\bxox[abposr]-[A-Za-z0-9\-]{10,}", MASK),
    (r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", MASK),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", MASK),
    (rf"://([^:/@{_W}]+):([^@/{_W}]+)@", "://$1:" + MASK + "@"),
    (rf"(?i)\b(authorization|proxy-authorization)\b([{_W}]*[:=][{_W}]*)(?:bearer[{_W}]+|basic[{_W}]+|token[{_W}]+)?[^{_W},;'\"]+", "$1$2" + MASK),
    (rf"(?i)\b(x-api-key|x-goog-api-key|api[-_]?key|apikey)\b([{_W}]*[:=][{_W}]*)[^{_W},;'\"]+", "$1$2" + MASK),
    (rf"(?i)\b([a-z0-9_\-]*(?:api[-_]?key|secret|token|password|passwd|credential)[a-z0-9_\-]*)([{_W}]*[:=][{_W}]*)(\"?)([^{_W},;&'\"]{{6,}})(\"?)", "$1$2$3" + MASK + "$5"),
]
#: What every text with a match of a rule holds, rule by rule: a rule runs over no other text.
_ANCHORS = [
    "sk-ant-", "sk-", "AIza", "GOCSPX-", r"gh[pousr]_", r"AKIA|ASIA", "hf_", r"xox[abposr]-", "eyJ", "PRIVATE KEY", "://",
    r"(?i)authorization", r"(?i)api[-_]?key", r"(?i)api[-_]?key|secret|token|password|passwd|credential",
]
_ANY = r"(?U)sk-|AIza|GOCSPX-|gh[pousr]_|AKIA|ASIA|hf_|xox[abposr]-|eyJ|PRIVATE KEY|://|(?i:authorization|api[-_]?key|secret|token|password|passwd|credential)"
#: Bytes of known values that may be broadcast.
MOST_BYTES = 64 << 20
# Names of what is secret.
SENSITIVE_WORDS = (
    r"api[_\-]?keys?|apikeys?|secrets?|secret[_\-]?keys?|passwords?|passwd|credentials?|authorization|auth[_\-]?(?:token|key|header)"
    r"|access[_\-]?tokens?|refresh[_\-]?tokens?|id[_\-]?tokens?|api[_\-]?tokens?|bearer[_\-]?tokens?|session[_\-]?tokens?"
    r"|private[_\-]?keys?|access[_\-]?keys?|session[_\-]?ids?|cookies?"
)
SENSITIVE_NAMES = ("token", "auth", "key", "secret", "password", "credential", "cookie", "bearer")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def redact(text, literals: tuple[str, ...] = ()) -> Column:
    """Known values first, the longest first (8 characters at least), then the patterns. Many
    values are for `Literals`: here each one is one more step of the plan."""
    out = F.col(text) if isinstance(text, str) else text
    for value in sorted({x for x in literals if len(x) >= SHORTEST_LITERAL}, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(value), F.lit(MASK))

    def step(has: Column, pattern: str, new: str):
        return lambda m: F.when(has, F.regexp_replace(m, f"(?U){pattern}", new)).otherwise(m)

    def rules(plain: Column) -> Column:
        masked = plain
        for (pattern, new), anchor in zip(RULES, _ANCHORS, strict=True):
            has = plain.rlike(f"(?U){anchor}") if re.search(r"[\[|(]", anchor) else plain.contains(anchor)
            masked = _let(masked, step(has, pattern, new))
        return masked

    return _let(out, lambda x: F.when(x.rlike(_ANY), rules(x)).otherwise(x))


class Literals:
    """Known values, found all at once: an automaton (Aho-Corasick) is broadcast as its words and built once in each
    worker, so that a plan is the same for ten values and for 100,000. Of values that overlap the longest one is
    masked, of equally long ones the first in order, of one value's own overlaps the leftmost; what
    is masked is not read again. Values shorter than 8 characters are left out; MOST_BYTES bounds the broadcast."""

    def __init__(self, spark: SparkSession, values: Iterable[str]):
        kept = sorted({x for x in values if x is not None and len(x) >= SHORTEST_LITERAL}, key=lambda x: (-len(x), x))
        if (size := sum(len(x.encode()) for x in kept)) > MOST_BYTES:
            raise ValueError(f"{size} bytes of known values are more than {MOST_BYTES}: mask them in several steps")
        self.count, self._words = len(kept), spark.sparkContext.broadcast(kept)

    def mask(self, text) -> Column:
        """The text with every known value masked; null stays null."""
        if not self.count:
            return F.col(text) if isinstance(text, str) else text
        words = self._words

        def run(texts: pd.Series) -> pd.Series:
            automaton = _automaton(words)
            return texts.map(lambda t: _masked(automaton, t), na_action="ignore")

        return F.pandas_udf(run, "string")(text)

    def redact(self, text) -> Column:
        return redact(self.mask(text))


_built: dict[int, object] = {}


def _automaton(words):
    """The worker's automaton of a broadcast list, built once; another list takes its place."""
    if id(words.value) not in _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for place, word in enumerate(words.value):
            found.add_word(word, (place, len(word)))
        found.make_automaton()
        _built.clear()
        _built[id(words.value)] = found
    return _built[id(words.value)]


def _masked(automaton, text: str) -> str:
    hits = sorted((place, end - n + 1, end + 1) for end, (place, n) in automaton.iter(text))
    if not hits:
        return text
    taken, spans = bytearray(len(text)), []
    for _, start, end in hits:
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            spans.append((start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


_SENSITIVE = rf"(?:^|[_\-.])(?:{SENSITIVE_WORDS})(?:$|[_\-.])"


def sensitive_name(name: str) -> bool:
    """sensitive_key of a name that is known when the plan is made."""
    low = name.strip().lower()
    return low in SENSITIVE_NAMES or re.search(_SENSITIVE, low) is not None


def sensitive_key(name) -> Column:
    """True where a key names a credential: a whole name, or a segment of one."""
    low = F.lower(strip(name))
    return low.isin(*SENSITIVE_NAMES) | low.rlike(_SENSITIVE)


#: Structures are gone through this many levels deep.
DEPTH = 12


def redact_value(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """Strings inside structs, maps and arrays masked by pattern; what a sensitive key holds is
    masked whole, whatever its type (nulls stay null)."""
    if depth > DEPTH:
        return value
    if isinstance(kind, T.StringType):
        return redact(value)
    whole = lambda v: F.when(v.isNotNull(), F.lit(MASK))
    if isinstance(kind, T.StructType):
        part = lambda f: whole(value[f.name]) if sensitive_name(f.name) else redact_value(value[f.name], f.dataType, depth + 1)
        return F.when(value.isNotNull(), F.struct(*[part(f).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        inner = lambda k, v: redact_value(v, kind.valueType, depth + 1)
        if isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(sensitive_key(k), whole(v)).otherwise(inner(k, v)))
        if isinstance(kind.keyType, T.StringType):  # a mask is a string: what else a secret held becomes null
            return F.transform_values(value, lambda k, v: F.when(~sensitive_key(k), inner(k, v)))
        return F.transform_values(value, inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, kind.elementType, depth + 1))
    return value


def redact_rows(rows: DataFrame) -> DataFrame:
    """All columns of a table as one structure, redacted."""
    out = rows.select(redact_value(F.struct(*rows.columns), rows.schema).alias("r"))
    return out.select("r.*")


def redact_map(column) -> Column:
    """redact_value of a map of strings."""
    return redact_value(F.col(column) if isinstance(column, str) else column, T.MapType(T.StringType(), T.StringType()))
