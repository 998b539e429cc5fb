"""Mail files as nested messages: a forward or reply holds the mail that it quotes, with a mark before it or without one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import functions as F

from threadloom.functions.text import EMAIL
from threadloom.functions.timeparse import DATE_FORMS
from threadloom.schemas import EMAIL as EMAIL_SCHEMA

#: Header names that a message's head may hold, besides x-*: fixed values.
HEADERS = {
    "message-id", "date", "from", "to", "cc", "bcc", "subject", "mime-version", "content-type", "content-transfer-encoding", "reply-to", "in-reply-to", "references", "sender", "sent",
    "return-path", "received", "list-id", "list-unsubscribe",
}
ADDRESSED = ("from", "to", "cc")
#: Names that the head of a quoted message is made of, and those that must stand beside its sender.
QUOTED_NAMES, BESIDE = {"from", "sent", "date", "to", "cc", "bcc", "subject"}, {"sent", "date", "to", "subject"}
MAX_DEPTH, FORWARD_LINES = 10, 100
#: Scores of places where a quoted message may begin: a mark, the sender's own line, a head (by its names), a quoted end. The first place of SURE or more wins, else the best.
MARK, NAMED, SURE, TAIL = 9, 3, 3, 1
_ADDRESS = re.compile(EMAIL)
_FORWARDED = re.compile(r"^\s*-{2,}\s*Forwarded by .*|^\s*-{5,}\s*Forwarded message\s*-{5,}\s*$", re.IGNORECASE)
_ORIGINAL = re.compile(r"^\s*-{3,}\s*Original Message\s*-{3,}\s*$", re.IGNORECASE)
_NAMED = re.compile(r'^\s*"?([^"<]*)"?\s*<([^<>\s]+@[^<>\s]+)>\s+on\s+(.+?)\s*$')
_QUOTE = re.compile(r"^\s*((?:>\s?)+)")
_REPLY, _FORWARD = re.compile(r"re:", re.IGNORECASE), re.compile(r"(?:fw|fwd):", re.IGNORECASE)


def address_of(value: str) -> str:
    found = _ADDRESS.search(value) or _ADDRESS.search(value.replace("]", "").strip("<> "))
    return found[0] if found else value.replace("]", "").strip("<> ")


def _field(line: str) -> tuple[str, str] | None:
    """The name, in lower case, and value of a header line; addresses are cut from their names."""
    name, colon, value = line.strip().partition(":")
    name, value = name.strip().lower(), value.strip()
    return (name, address_of(value) if name in ADDRESSED else value) if colon else None


def headers_of(lines: list[str]) -> tuple[dict[str, str], int]:
    """The head of a message and the number of lines that it takes; it ends at a blank line or an unknown header.

    Lines without a colon, such as folded ones, and quoted lines are passed over."""
    head: dict[str, str] = {}
    for i, line in enumerate(lines):
        if not line.strip() and head:
            return head, i + 1
        field = _field(line)
        if field is None or line.lstrip().startswith(">"):
            continue
        if field[0] in HEADERS or field[0].startswith("x-"):
            head[field[0]] = field[1]
        else:
            return (head, i) if head else ({}, 0)
    return (head, len(lines)) if head else ({}, 0)


def quoted_head(lines: list[str], at: int = 0) -> tuple[dict[str, str], int]:
    """The head that quoted lines begin with at `at`, and the place after it: header lines and folded ones, without a gap.

    A blank line after the head belongs to it."""
    head: dict[str, str] = {}
    for i in range(at, len(lines)):
        field = _field(lines[i])
        if field and field[0] in QUOTED_NAMES:
            head.setdefault(*field)
        elif not (head and lines[i].strip() and lines[i][:1] in " \t"):  # a folded line goes on
            return head, i + (not lines[i].strip())
    return head, len(lines)


def _level(line: str) -> int:
    m = _QUOTE.match(line)
    return m[1].count(">") if m else 0


def _unquoted(line: str, levels: int) -> str:
    """A line without so many levels of quoting, or as many as it has."""
    return re.sub(rf"^\s*(?:>\s?){{0,{levels}}}", "", line) if levels and _level(line) else line


def next_cut(lines: list[str]) -> tuple[int, str]:
    """Where a quoted message begins among a body's lines, and how: forward, reply (marks), named, head, quote; (their number, '') if none.

    Every line is scored as the beginning: a mark, a line that names sender and date, a run of header lines that tell
    the sender and at least one more (by their number, an address counting for one), the first line of an end that is
    all quoted. Quoting does not matter for the scores."""
    tail = len(lines)
    while tail and (not lines[tail - 1].strip() or _level(lines[tail - 1])):
        tail -= 1
    tail = next((i for i in range(tail, len(lines)) if lines[i].strip()), len(lines))
    best = (0, len(lines), "")
    for i, line in enumerate(lines):
        bare = _unquoted(line, _level(line))
        score, kind = 0, ""
        if i < FORWARD_LINES and _FORWARDED.match(bare):
            score, kind = MARK, "forward"
        elif _ORIGINAL.match(bare):
            score, kind = MARK, "reply"
        elif _NAMED.match(bare):
            score, kind = NAMED, "named"
        elif (field := _field(bare)) and field[0] == "from":
            level = _level(line)
            head, _ = quoted_head([_unquoted(x, level) for x in lines[i : i + 2 * len(QUOTED_NAMES)]])
            if "from" in head and BESIDE & set(head):
                score, kind = len(head) + bool(_ADDRESS.search(head["from"])), "head"
        if not score and i == tail and i:
            score, kind = TAIL, "quote"
        if score > best[0]:
            best = (score, i, kind)
        if best[0] >= SURE:
            break
    return best[1:]


def _opened(lines: list[str], how: str, outer: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """The head and body of a message that begins as `how` says; a quoted one without a head answers for what its reply's says."""
    while lines and not lines[0].strip():
        lines = lines[1:]
    if how in ("forward", "reply", "named"):
        named = next(((i, m) for i, m in enumerate(map(_NAMED.match, lines[:3])) if m), None)
        if named:
            head, used = quoted_head(lines, named[0] + 1)
            return {"from": named[1][2], "date": named[1][3]} | head, lines[used:]
    if how in ("head", "quote"):
        head, used = quoted_head(lines)
        if how == "quote":
            about = {"from": outer.get("to"), "to": outer.get("from"), "subject": _REPLY.sub("", outer.get("subject", ""), count=1).strip()}
            head = {k: v for k, v in about.items() if v} | head
        return head, lines[used if "from" in head or used > 1 else 0 :]
    head, used = headers_of(lines)
    return head, lines[used:]


def messages_of(text: str) -> list[dict]:
    """The messages of a mail file, outermost first: headers, body, flags, depth.

    is_forwarded: its subject says so or a forwarded mail follows its body. is_reply: its subject says so and it quotes
    something, or it is quoted itself. is_original: it is quoted by a reply."""
    found: list[dict] = []
    lines, depth, how = text.split("\n"), 0, ""
    while depth <= MAX_DEPTH:
        head, rest = _opened(lines, how, found[-1]["headers"] if found else {})
        at, then = next_cut(rest)
        subject, quoted = head.get("subject", ""), how in ("reply", "head", "quote", "named")
        quotes = any(">" in x for x in rest) or then in ("reply", "head", "quote", "named")
        found.append(
            {
                "headers": head, "body": "\n".join(rest[:at]).strip(), "is_forwarded": bool(_FORWARD.match(subject)) or then == "forward",
                "is_reply": quoted or bool(_REPLY.match(subject)) and quotes, "is_original": quoted, "depth": depth,
            }
        )
        if not then:
            break
        level = _level(rest[at])
        lines = [_unquoted(x, level) for x in rest[at + (then in ("forward", "reply")) :]]
        if not any(x.strip() for x in lines):
            break
        depth, how = depth + 1, then
    return found


#: Seconds by which an original message counts as older, so that it comes before the mail that answers it.
ORIGINAL_SHIFT = 100_000_000


def seconds_of(date: str | None) -> float | None:
    """Seconds of a mail's date in any of DATE_FORMS, without a zone in UTC, or as mail standards write it; null if it is none."""
    cut = re.sub(r"\s*\([A-Za-z]+\)\s*$", "", date or "").strip()
    for form in DATE_FORMS:
        try:
            at = datetime.strptime(cut, form)
        except ValueError:
            continue
        return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()
    try:
        at = parsedate_to_datetime(cut)
    except (ValueError, TypeError, IndexError):
        return None
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()


def oldest_first(messages: list[dict]) -> list[dict]:
    """Messages from the oldest on, originals taken for ORIGINAL_SHIFT older, undated ones before dated ones, deeper
    first; the oldest counts as no forward and no reply. Each has its date's `seconds`."""
    dated = [m | {"seconds": seconds_of(m["headers"].get("date") or m["headers"].get("sent"))} for m in messages]

    def key(item: tuple[int, dict]) -> tuple:
        i, m = item
        if m["seconds"] is None:
            return (0 if m["is_original"] else 1, -m["depth"], i)
        return (m["seconds"] - ORIGINAL_SHIFT if m["is_original"] else m["seconds"], i)

    ordered = [m for _, m in sorted(enumerate(dated), key=key)]
    return [m | {"email_index": i} | ({"is_forwarded": False, "is_reply": False} if i == 0 else {}) for i, m in enumerate(ordered)]


@F.pandas_udf(EMAIL_SCHEMA)
def parsed_mail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A mail file's messages, oldest first; null for a null."""
    for s in batches:
        yield s.map(lambda x: oldest_first(messages_of(x)) if isinstance(x, str) else None)
