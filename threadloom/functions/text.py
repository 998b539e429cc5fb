"""Text as Column functions."""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.schemas import DEMOGRAPHICS, PERSONA_LISTS

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
#: Reply and forward marks of subjects, wherever they stand.
SUBJECT_MARKS = "Re:|RE:|re:|Fwd:|FWD:|fwd:|FW:|fw:|Fw:|fW:"
#: Bodies of comments that were taken down, in lower case.
DELETED = ("", "[removed]", "[deleted]", "[deleted by user]")


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def tokens(x: Column) -> Column:
    """Words between white space; none of a blank text."""
    return F.filter(F.split(x, "\\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(tokens(x))


def word_truncate(x: Column, n: int) -> Column:
    """A text of more than n words cut to n, joined by single blanks; others, and n <= 0, unchanged."""
    if n <= 0:
        return x
    return F.when(word_count(x) > n, F.array_join(F.slice(tokens(x), 1, n), " ")).otherwise(x)


def format_messages(prompt: Column) -> Column:
    """Turns but for system ones as 'Message from role:' and the quoted content, one after the other; null gives ''."""
    spoken = F.filter(prompt, lambda x: x["role"] != "system")
    lines = F.transform(spoken, lambda x: F.concat(F.lit("Message from "), x["role"], F.lit(": \n'''\n"), F.coalesce(x["content"], F.lit("")), F.lit("\n'''")))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def format_messages_titled(prompt: Column) -> Column:
    """format_messages with the first turn introduced as an article by title and subtitle from its metadata."""
    first = F.get(prompt, F.lit(0))
    field = lambda p: F.get_json_object(first["metadata"], p)
    title = F.coalesce(F.nullif(field("$.counts.title"), F.lit("")), field("$.title"), F.lit(""))
    subtitle = F.coalesce(field("$.subtitle"), F.lit(""))
    head = F.concat(F.lit("Article from "), first["role"], F.lit(": \nTitle: "), title, F.lit("\nSubtitle: "), subtitle, F.lit("\n'''\n"), F.coalesce(first["content"], F.lit("")), F.lit("\n'''"))
    rest = format_messages(F.slice(prompt, 2, F.greatest(F.size(prompt) - 1, F.lit(0))))
    return F.when(F.size(prompt) > 0, F.concat_ws("\n", head, F.nullif(rest, F.lit("")))).otherwise(F.lit(""))


def sanitize_name(x: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(x, "[^\\w\\-]", "-"), "-+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def safe_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]", "_")


def email_field(x: Column) -> Column:
    """The first address in a header field; without one, the field stripped of brackets."""
    bare = strip(F.regexp_replace(F.regexp_replace(x, "\\]", ""), "[<>]", ""))
    return F.coalesce(F.nullif(F.regexp_extract(x, f"({EMAIL})", 1), F.lit("")), F.nullif(F.regexp_extract(bare, f"({EMAIL})", 1), F.lit("")), bare)


def normalize_subject(x: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), SUBJECT_MARKS, ""), "\\s+", " "))
    return F.when(bare == "", "(no subject)").otherwise(bare)


def strip_prefix_letters(x: Column, letters: str = "r/") -> Column:
    """Without leading characters of a set."""
    return F.ltrim(x, F.lit(letters))


def _code_point(number: Column) -> Column:
    """The character of a number, as HTML reads it: what it cannot be is U+FFFD, what no text holds is nothing."""
    known = F.map_from_arrays(F.lit(list(html._invalid_charrefs)), F.lit(list(html._invalid_charrefs.values())))
    never = number.isin(sorted(html._invalid_codepoints))
    beyond = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.coalesce(number, F.lit(0))), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(known, number.cast("int")), F.when(beyond, "\ufffd").when(never, "").otherwise(char))


def _entity(rest: Column) -> Column:
    """What follows an ampersand, with the entity that it begins with as its character; the ampersand and all if there is none.

    A name with its semicolon is looked up as a whole; else the longest name that needs none counts."""
    names = {k: v for k, v in html5.items() if k.endswith(";")}
    bare = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    whole = F.regexp_extract(rest, "^([A-Za-z][A-Za-z0-9]*;)", 1)
    short = F.regexp_extract(rest, f"^({'|'.join(bare)})", 1)
    decimal, hexa = F.regexp_extract(rest, "^#([0-9]+;?)", 1), F.regexp_extract(rest, "^#[xX]([0-9a-fA-F]+;?)", 1)
    look = lambda table, key: F.try_element_at(F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values()))), key)
    # numbers of more digits than any character's are beyond all of them
    number = lambda digits, base, most: F.when(F.length(F.ltrim(F.rtrim(digits, F.lit(";")), F.lit("0"))) <= most, F.conv(F.rtrim(digits, F.lit(";")), base, 10).cast("long"))
    after = lambda n: F.substring(rest, n + 1, F.length(rest))
    numbered = F.when(decimal != "", F.concat(_code_point(number(decimal, 10, 10)), after(F.length(decimal) + 1))).when(hexa != "", F.concat(_code_point(number(hexa, 16, 8)), after(F.length(hexa) + 2)))
    named = F.when(whole != "", F.concat(look(names, whole), after(F.length(whole))))
    loose = F.when(short != "", F.concat(look({k: html5[k] for k in bare}, short), after(F.length(short))))
    return F.coalesce(numbered, named, loose, F.concat(F.lit("&"), rest))


def unescape(x: Column) -> Column:
    """HTML entities as characters, named and numbered, as HTML reads them; a text without an ampersand is left as it is."""
    parts = F.split(x, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _entity)
    return F.when(F.contains(x, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(x)


def escape(x: Column) -> Column:
    """HTML-escaped, with line breaks."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def collapse_quotes(x: Column) -> Column:
    """Each run of lines that begin with '>' becomes its first line and a mark, if a line without '>' follows it."""
    quoted = lambda line: F.coalesce(line.rlike("^\\s*>"), F.lit(False))
    none = F.array().cast("array<string>")

    def keep(lines: Column, line: Column, i: Column) -> Column:
        # a run's first line stays; the mark follows where the run ends before another line
        begins = F.when(~quoted(F.coalesce(F.get(lines, i - 1), F.lit(""))), F.array(strip(line))).otherwise(none)
        ends = (F.size(lines) > i + 1) & ~quoted(F.coalesce(F.get(lines, i + 1), F.lit("")))
        return F.when(quoted(line), F.concat(begins, F.when(ends, F.array(F.lit("[...quoted text...]"))).otherwise(none))).otherwise(F.array(line))

    # the lines are bound to a lambda's variable, so that a text is split once and not for each of its lines
    joined = lambda lines: F.array_join(F.flatten(F.transform(lines, lambda line, i: keep(lines, line, i))), "\n")
    return F.element_at(F.transform(F.array(F.split(x, "\n")), joined), 1)


def clean_text(x: Column) -> Column:
    return strip(collapse_quotes(F.replace(unescape(x), F.lit("```"), F.lit(""))))


def post_content(title: Column, body: Column, is_self: Column) -> Column:
    return F.when(is_self & (strip(body) != ""), F.concat(title, F.lit("\n\n"), clean_text(body))).otherwise(title)


def cut_reply(x: Column) -> Column:
    """A mail body up to the original message that it quotes, without quoted lines at its end."""
    head = F.element_at(F.split(x, "-----\\s*Original Message\\s*-----"), 1)
    return strip(F.regexp_replace(head, "(\\n\\s*>[^\\n]*)+\\s*$", ""))


def response_of(x: Column, fallback: str = "") -> Column:
    """A model's answer: what follows </think>, inside <response> if there is one, without stray tags."""
    after = F.when(F.instr(x, "</think>") > 0, F.substring(x, F.instr(x, "</think>") + len("</think>"), F.length(x))).otherwise(x)
    inside = F.nullif(F.regexp_extract(after, "(?s)<response>(.*?)</response>", 1), F.lit(""))
    bare = strip(F.regexp_replace(F.coalesce(inside, after), "</?(?:think|response)>", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(fallback))


def fenced_json(x: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_extract(x, "(?s)```(?:json)?\\s*(.*?)```", 1)), F.lit("")), strip(x))


def fill(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns; null is empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def chat_template(messages: Column, names: Column | None = None) -> Column:
    """Turns in a chat model's mark-up, ready for the assistant's answer."""
    turn = lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), F.coalesce(x["content"], F.lit("")), F.lit("<|im_end|>\n"))
    start = F.lit("<|im_start|>assistant\n") if names is None else F.concat(F.lit("<|im_start|>"), names, F.lit("\n"))
    return F.concat(F.array_join(F.transform(messages, turn), ""), start)


def size_text(n: Column) -> Column:
    return (
        F.when(n >= 1 << 30, F.format_string("%.2f GB", n / (1 << 30))).when(n >= 1 << 20, F.format_string("%.2f MB", n / (1 << 20))).otherwise(F.format_string("%.2f KB", n / (1 << 10)))
    )


def md5_share(x: Column) -> Column:
    """md5 as a number modulo 10000, over 10000: a reproducible draw from [0, 1)."""
    h = F.md5(x)
    digits = F.sequence(F.lit(1), F.lit(32))
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, i: (acc * 16 + F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("long")) % 10000)
    return value / 10000


def dropped_fields(fields: list[str], persona_id: Column, seed: int, p: float, most: int) -> Column:
    """The fields of a persona that are dropped: min(int(5 p), most) of them, those with the greatest md5s of seed, persona and field."""
    n = min(int(p * 5), most, len(fields))
    if n <= 0:
        return F.array().cast("array<string>")
    drawn = F.array(*[F.struct(F.md5(F.concat_ws("_", F.lit(str(seed)), persona_id, F.lit("field"), F.lit(f))).alias("h"), F.lit(f).alias("f")) for f in fields])
    return F.transform(F.slice(F.array_sort(drawn), len(fields) - n + 1, n), lambda x: x["f"])


def persona_text(persona: Column, persona_id: Column, field_p: float = 0.0, item_p: float = 0.0, seed: int = 42) -> Column:
    """A persona (struct of demographics and lists) in lines, with fields and items dropped by md5; what is left out is 'Missing'.

    Fields go by dropped_fields, of all five (four at most), or of the lists alone (three at most) where demographics
    say nothing. An item goes if the draw of seed, persona and item is below `item_p`."""
    gone = lambda key: md5_share(F.concat_ws("_", F.lit(str(seed)), persona_id, F.lit("item"), key)) < item_p if item_p else F.lit(False)
    told = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), persona["demographics"][k].alias("v")) for k in DEMOGRAPHICS]), lambda x: (F.coalesce(x["v"], F.lit("")) != "") & (strip(x["v"]) != "NA"))
    fields = ["demographics", *PERSONA_LISTS]
    dropped = F.when(F.size(told) > 0, dropped_fields(fields, persona_id, seed, field_p, 4)).otherwise(dropped_fields(fields[1:], persona_id, seed, field_p, 3))
    lines = F.transform(F.filter(told, lambda x: ~gone(F.concat(x["k"], F.lit(":"), x["v"]))), lambda x: F.concat(F.lit("  "), x["k"], F.lit(": "), x["v"]))
    out = [F.when(~F.array_contains(dropped, "demographics") & (F.size(lines) > 0), F.concat(F.lit("Demographics:\n"), F.array_join(lines, "\n"))).otherwise(F.lit("Demographics: Missing"))]
    for name in PERSONA_LISTS:
        held = F.filter(F.coalesce(persona[name], F.array().cast("array<string>")), lambda x: ~gone(x))
        shown = F.concat(F.lit(f"{name.capitalize()}: \n  "), F.array_join(held, "\n  "))
        out.append(F.when(~F.array_contains(dropped, name) & (F.size(held) > 0), shown).otherwise(F.lit(f"{name.capitalize()}: Missing")))
    return F.concat_ws("\n", *out)


def id_suffix(x: Column) -> Column:
    return F.substring_index(x, "_", -1)


def enough_words(x: Column, n: int) -> Column:
    return F.coalesce(word_count(x) >= n, F.lit(False))


def distinct_ranks(*ranks: Column) -> Column:
    """Whether ranks, compared by their first words, are all different."""
    first = F.array(*[F.substring_index(r, " ", 1) for r in ranks])
    return F.size(F.array_distinct(first)) == len(ranks)
