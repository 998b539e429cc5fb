"""A chat model's prompt from turns with names, thoughts, tools and their answers, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the mark-up says about tools, before and after their list: fixed values.
TOOLS_BEFORE = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_AFTER = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
    '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)
START, END = "<|im_start|>", "<|im_end|>\n"
#: A turn.
TURN = "struct<role:string,content:string,name:string,reasoning_content:string,tool_calls:array<struct<name:string,arguments:string>>>"


def _cut(x: Column, lead: bool = True, trail: bool = True) -> Column:
    """Without line feeds before or behind."""
    x = F.ltrim(x, F.lit("\n")) if lead else x
    return F.rtrim(x, F.lit("\n")) if trail else x


def _name(name: Column, after: str = "") -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("<name>"), name, F.lit(f"</name>{after}"))).otherwise("")


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def last_query(turns: Column) -> Column:
    """The place (from 0) of the last user turn that is no tool's answer; the last turn's if there is none."""
    def asked(t: Column) -> Column:
        answer = t["content"].startswith("<tool_response>") & t["content"].endswith("</tool_response>")
        return (t["role"] == "user") & t["content"].isNotNull() & ~answer

    found = F.array_max(F.transform(turns, lambda t, i: F.when(asked(t), i)))
    return F.coalesce(found, F.size(turns) - 1)


def _calls(calls: Column, content: Column) -> Column:
    """Tool calls, a line each, apart from what is said before them."""
    shown = F.transform(calls, lambda c, i: _joined(F.when((i > 0) | (content != ""), "\n").otherwise(""), '<tool_call>\n{"name": "', c["name"], '", "arguments": ', c["arguments"], "}\n</tool_call>"))
    return F.coalesce(F.array_join(shown, ""), F.lit(""))


def _said(turn: Column, after_query: Column, last: Column) -> Column:
    """An assistant's turn; its thoughts are shown only after the last query, in the last turn or where there are any."""
    raw = F.coalesce(turn["content"], F.lit(""))
    parts = F.split(raw, "</think>")
    inside = turn["reasoning_content"].isNull() & (F.size(parts) > 1)
    thought = _cut(F.element_at(F.split(_cut(parts[0], lead=False), "<think>"), -1), trail=False)
    thought = F.coalesce(turn["reasoning_content"], F.when(inside, thought), F.lit(""))
    content = F.when(inside, _cut(F.element_at(parts, -1), trail=False)).otherwise(raw)
    shown = F.when(after_query & (last | (thought != "")), _joined("<think>\n", _cut(thought), "\n</think>\n\n", _cut(content, trail=False))).otherwise(content)
    return _joined(START, "assistant\n", _name(turn["name"], "\n"), shown, _calls(turn["tool_calls"], content), END)


def chat_prompt(turns: Column, tools: Column | None = None, speak_as: Column | None = None, thinking: bool | None = None, ask: bool = True) -> Column:
    """Turns (array of TURN) in a chat model's mark-up.

    A fold over the turns whose state is the text so far and whether a run of tools' answers is open: such a run is one
    user turn. tools: an array of their JSON, told in the first system turn. ask: open the next user's turn, of
    `speak_as`, with an empty thought (thinking=False) or an open one (True). Turns of other roles are left out."""
    first = F.get(turns, F.lit(0))
    system = first["role"].eqNullSafe("system")
    plain = F.when(system, _joined(START, "system\n", F.coalesce(first["content"], F.lit("")), END)).otherwise("")
    if tools is not None:
        told = _joined(START, "system\n", F.when(system, _joined(F.coalesce(first["content"], F.lit("")), "\n\n")).otherwise(""), TOOLS_BEFORE, F.array_join(F.transform(tools, lambda t: _joined("\n", t)), ""), TOOLS_AFTER, END)
        plain = F.when(F.coalesce(F.size(tools) > 0, F.lit(False)), told).otherwise(plain)
    query, n = last_query(turns), F.size(turns)
    placed = F.transform(turns, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def told_on(state: Column, x: Column) -> Column:
        t, i = x["t"], x["i"]
        asked = (t["role"] == "user") | ((t["role"] == "system") & (i > 0))
        person = _joined(START, t["role"], "\n", _name(t["name"]), "\n", F.regexp_replace(F.coalesce(t["content"], F.lit("")), "^\\s+|\\s+$", ""), END)
        answer = _joined(F.when(state["open"], "").otherwise(f"{START}user"), "\n<tool_response>\n", F.coalesce(t["content"], F.lit("")), "\n</tool_response>")
        is_tool = F.coalesce(t["role"] == "tool", F.lit(False))
        ended = F.when(state["open"] & ~is_tool, END).otherwise("")
        more = F.when(is_tool, answer).when(asked, person).when(t["role"] == "assistant", _said(t, i > query, i == n - 1)).otherwise("")
        return F.struct(F.concat(state["text"], ended, more).alias("text"), is_tool.alias("open"))

    start = F.struct(plain.alias("text"), F.lit(False).alias("open"))
    whole = F.aggregate(placed, start, told_on, lambda s: F.concat(s["text"], F.when(s["open"], END).otherwise("")))
    if not ask:
        return whole
    thought = {None: "", False: "<think>\n\n</think>\n\n", True: "<think>"}[thinking]
    return _joined(whole, START, "user\n", _name(speak_as) if speak_as is not None else "", "\n", thought)
