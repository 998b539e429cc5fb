"""JSON in strings and nested values."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.schemas import DEMOGRAPHICS, PERSONA, PERSONA_LISTS, PROMPT

NO_PERSONA = "No training data available for this user"


def prompt_from_json(x: Column) -> Column:
    return F.from_json(x, PROMPT)


def metadata_or_empty(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("{}"))


def normal_prompt(prompt: Column) -> Column:
    """Turns of exactly role, content, metadata, the last never empty."""
    return F.transform(prompt, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), metadata_or_empty(x["metadata"]).alias("metadata")))


def _present(value: Column) -> Column:
    return value.isNotNull() & ~value.isin("", "[]", "{}", "0", "false", "null")


def enrichment_text(metadata: Column, paths: list[str]) -> Column:
    """'path=value' of dotted paths whose values are not empty, joined by commas."""
    parts = [F.when(_present(F.get_json_object(metadata, f"$.{p}")), F.concat(F.lit(f"{p}="), F.get_json_object(metadata, f"$.{p}"))) for p in paths]
    return F.concat_ws(", ", *parts)


def with_context(text: Column, metadata: Column, paths: list[str]) -> Column:
    extra = enrichment_text(metadata, paths)
    return F.when(extra != "", F.concat(text, F.lit("\n[Additional Context: "), extra, F.lit("]"))).otherwise(text)


def renamed_fields(metadata: Column, names: dict[str, str]) -> Column:
    """JSON of dotted paths under new names; absent values are left out."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names.values()]), F.array(*[F.get_json_object(metadata, f"$.{p}") for p in names]))
    return F.to_json(F.map_filter(pairs, lambda _, v: v.isNotNull()))


def persona_is_valid(x: Column) -> Column:
    """Exactly the persona's keys, demographics all strings, and its lists not empty."""
    keys = lambda doc, wanted: F.coalesce((F.size(F.array_except(F.json_object_keys(doc), wanted)) == 0) & (F.size(F.array_except(wanted, F.json_object_keys(doc))) == 0), F.lit(False))
    names = lambda values: F.array(*[F.lit(v) for v in values])
    parsed = F.from_json(x, PERSONA)
    strings = F.forall(F.map_values(F.from_json(F.get_json_object(x, "$.demographics"), "map<string,string>")), lambda v: v.isNotNull())
    lists = [F.coalesce((F.size(parsed[k]) > 0) & F.forall(parsed[k], lambda v: v.isNotNull()), F.lit(False)) for k in PERSONA_LISTS]
    ok = keys(x, names(["demographics", *PERSONA_LISTS])) & keys(F.get_json_object(x, "$.demographics"), names(DEMOGRAPHICS)) & F.coalesce(strings, F.lit(False))
    for item in lists:
        ok = ok & item
    return ok


def default_persona() -> Column:
    return F.lit(json.dumps({"demographics": dict.fromkeys(DEMOGRAPHICS, "unknown"), **{k: ["unknown"] for k in PERSONA_LISTS}}))


def persona_or_default(x: Column) -> Column:
    return F.coalesce(x, F.lit(NO_PERSONA))


#: Pieces of nearly-JSON: strings in three or one quotes (with line breaks in them), punctuation, words and numbers.
_PIECE = re.compile(r"""\s*(?:(?P<long>\'{3}.*?\'{3}|"{3}.*?"{3})|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<mark>[][{}:,])|(?P<word>(?i:true|false|null|none))|(?P<number>[-+0-9.eE]+))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "null": None, "none": None}
_CLOSES = {"}": "{", "]": "["}


def scalar_of(text: str) -> object:
    """What a quoted text stands for: a literal, a finite number, or itself."""
    if text.lower() in ("true", "false", "null"):
        return _WORDS[text.lower()]
    for kind in (float,) if "." in text or "e" in text.lower() else (int,):
        try:
            number = kind(text)
        except ValueError:
            continue
        if math.isfinite(number):
            return number
    return text


def _number(text: str) -> float | int:
    number = float(text) if re.search("[.eE]", text) else int(text)
    if not math.isfinite(number):
        raise ValueError("JSON has no infinite numbers")
    return number


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)


def _folded(kind: str, pieces: list[tuple[str, object]]) -> object:
    """The list or object of the pieces between its brackets: members stand between commas, one of which may follow the last."""
    members: list[list[tuple[str, object]]] = [[]]
    for piece in pieces:
        if piece == ("mark", ","):
            members.append([])
        else:
            members[-1].append(piece)
    if not members[-1]:
        members.pop()
    if kind == "[":
        if any(len(m) != 1 or m[0][0] == "mark" for m in members):
            raise ValueError("a list's members must be parted by commas")
        return [m[0][1] for m in members]
    if any(len(m) != 3 or m[1] != ("mark", ":") or "mark" in (m[0][0], m[2][0]) for m in members):
        raise ValueError("an object's members must be keys and values")
    return {m[0][1]: m[2][1] for m in members}


def _values(body: str) -> object:
    """The value of nearly-JSON: pieces gather in the innermost open bracket, and a closing one folds what it holds. Linear in the text."""
    open_: list[tuple[str, list[tuple[str, object]]]] = [("", [])]
    at, end = 0, len(body.rstrip())
    while at < end:
        m = _PIECE.match(body, at)
        if not m:
            raise ValueError(f"unexpected text at {at}")
        at, kind, piece = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "mark" and piece in "{[":
            open_.append((piece, []))
        elif kind == "mark" and piece in "}]":
            opened, pieces = open_.pop()
            if opened != _CLOSES[piece]:
                raise ValueError("brackets do not match")
            open_[-1][1].append(("value", _folded(opened, pieces)))
        elif kind == "mark":
            open_[-1][1].append(("mark", piece))
        elif kind == "number":
            open_[-1][1].append(("value", _number(piece)))
        else:
            open_[-1][1].append(("value", scalar_of(piece[3:-3]) if kind == "long" else scalar_of(_unquoted(piece)) if kind == "text" else _WORDS[piece.lower()]))
    if len(open_) != 1 or len(open_[0][1]) != 1 or open_[0][1][0][0] == "mark":
        raise ValueError("no single value")
    return open_[0][1][0][1]


def parse_tolerantly(text: str | None) -> str | None:
    """The object in a text that is JSON or nearly so, as JSON: single or triple quotes, line breaks in strings, trailing
    commas, literals of any case and surrounding text are forgiven, and quoted literals and numbers are what they say;
    null if there is none, or if it is nested too deep to be written."""
    if not text or "{" not in text or "}" not in text:
        return None
    try:
        value = _values(text[text.index("{") : text.rindex("}") + 1])
        return json.dumps(value, ensure_ascii=False, allow_nan=False) if isinstance(value, dict) else None
    except (ValueError, TypeError, OverflowError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def tolerant_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """parse_tolerantly by Arrow batches, for texts that from_json cannot read."""
    for s in batches:
        yield s.map(parse_tolerantly, na_action="ignore").astype(object).where(lambda x: x.notna(), None)


def read_object(x: Column) -> Column:
    """Well-formed objects as they are; only others, and those with quoted literals or numbers, go through Python."""
    well = F.from_json(x, "map<string,string>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}).isNotNull() & F.trim(x).startswith("{")
    well = F.coalesce(well & ~x.rlike('"\\s*(?i:true|false|null|[-+]?[0-9._]+(?:e[-+]?[0-9]+)?)\\s*"'), F.lit(False))
    return F.coalesce(F.when(well, x), tolerant_json(F.when(~well, x)))


def without_empty(value: object, drop: frozenset[str] = frozenset()) -> object:
    """A JSON value without the keys `drop` and without objects that are empty or become so; None if nothing is left."""
    if isinstance(value, dict):
        kept = {k: w for k, v in value.items() if k not in drop and (w := without_empty(v, drop)) is not None}
        return kept or None
    if isinstance(value, list):
        return [w for v in value if (w := without_empty(v, drop)) is not None]
    return value


def nulled_empty(value: object, drop: frozenset[str] = frozenset()) -> object:
    """A JSON value without the keys `drop`, with null for an object that is a key's value and empty, or becomes so."""
    if isinstance(value, dict):
        return {k: (nulled_empty(v, drop) or None) if isinstance(v, dict) else nulled_empty(v, drop) for k, v in value.items() if k not in drop}
    if isinstance(value, list):
        return [nulled_empty(v, drop) for v in value]
    return value


def cleaned_json(x: Column, drop: list[str] | None = None, empty: str = "drop") -> Column:
    """JSON strings of any shape without the keys `drop` and without empty objects, by Arrow batches; null for what is no JSON.

    empty: `drop` leaves empty objects out (without_empty; null if nothing is left), `null` puts a null in their place."""
    names = frozenset(drop or ())
    change = {"drop": without_empty, "null": nulled_empty}[empty]

    @F.pandas_udf(T.StringType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                left = change(json.loads(text), names) if isinstance(text, str) else None
                return None if left is None else json.dumps(left, ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        for s in batches:
            yield pd.Series([one(t) for t in s], dtype=object)

    return clean(x)
