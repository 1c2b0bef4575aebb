"""Sessions of a tool log: events, and references to absolute paths with their sources and confidence.

Paths in free text: one pattern finds where a path starts (drive, share, slash
or file URI after a blank, bracket or =) and how far it can reach; what ends
it early (a file extension before a blank, closing brackets, punctuation, a
line number) is cut by a second one. Paths may hold blanks.
"""

from __future__ import annotations

import json
import ntpath
import posixpath
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Expired
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LONGEST_PATH, LONGEST_TEXT, LONGEST_LINE = 400, 2_000_000, 2_000_000
#: Levels of a JSON value that are searched for paths.
DEEPEST = 8

# Sources in order of priority, confidences in order of rank.
SOURCES = ("prompt", "user-provided", "search-tool", "other-tool")
CONFIDENCES = ("low", "medium", "high")

# Brackets that may stand around a path, sentence marks that end one, words that join two of them,
# beginnings of base64 data of common formats.
OPENING, CLOSING = "\"'`([{<「『【〔〈《（［｛", "\"'`)]}>」』】〕〉》）］｝"
MARKS, WIDE_MARKS = ",:;.!?", "、。…，：；！？"
BARRIERS = "\"'`<>|()[]{}，。、！？；：…」』】〕〉》）］｝"
JOINING = ("與", "和", "及", "以及", "and", "or", "&")
BASE64 = ("9j/", "iVBORw0KGgo", "R0lGOD", "JVBER", "UEsDB", "H4sI", "eyJ")

_one = lambda letters: "[" + re.escape(letters) + "]"
_BEGIN = r"(?:file://|[A-Za-z]:[\\/]|\\\\|/)"
_BEFORE = rf"(?:(?<=\s)|(?<={_one(OPENING)})|(?<=[=：])|^)"
_CANDIDATE = re.compile(rf"{_BEFORE}(?=({_BEGIN}(?:(?!{_BEFORE}{_BEGIN})[^\r\n{re.escape(BARRIERS)}])*))", re.M | re.I)
_EXTENDED = re.compile(r"^.*?\.[A-Za-z0-9]{1,16}(?=\s|$)", re.S)
_CJK_EXTENDED = re.compile(rf"^[^{WIDE_MARKS}]+\.[A-Za-z0-9]{{1,16}}(?=[{WIDE_MARKS}])")
_LEADING = re.compile(rf"^(?:\s|{_one(OPENING)})+")
_TRAILING = re.compile(rf"(?:\s|:\d+|{_one(CLOSING + MARKS + WIDE_MARKS)})+$")
_JOINED = re.compile(rf"(?<=[\\/])\s+(?:{'|'.join(map(re.escape, JOINING))})\s*$", re.I)
_NO_PATH = re.compile(rf"/*(?:{'|'.join(BASE64)})|(?i:data|https?|ftp):|//[^/]|.*(?i:;base64(?:[,;]|$))", re.S)
_WINDOWS = re.compile(r"[A-Za-z]:[\\/]|\\\\")


def bare(token: str) -> str:
    """A token without what stands around it: brackets, punctuation, a line number."""
    token = _LEADING.sub("", token)
    early = _CJK_EXTENDED.match(token)
    return _TRAILING.sub("", early[0] if early else token)


def _from_uri(token: str) -> str:
    parts = urlsplit(token)
    path = unquote(parts.path)
    if parts.hostname and parts.hostname != "localhost":
        return "\\\\" + parts.hostname + path.replace("/", "\\")
    return path[1:] if _WINDOWS.match(path[1:]) else path


def absolute_path(value: str) -> str | None:
    """The absolute path that a token stands for, else None: URLs, data and what is too long are none."""
    token = bare(value)
    if token[:7].lower() == "file://":
        token = bare(_from_uri(token))
    if not 0 < len(token) <= LONGEST_PATH or len(token.splitlines()) > 1 or _NO_PATH.match(token):
        return None
    if _WINDOWS.match(token):
        path = ntpath.normpath(token)
        return path if path.endswith(":\\") else path.rstrip("\\")
    return "/" + posixpath.normpath(token).strip("/") if token[0] == "/" else None


def path_key(path: str) -> str:
    """Windows paths are the same in any case."""
    return path.lower() if _WINDOWS.match(path) else path


def paths_in(text: str) -> list[str]:
    """The absolute paths that a text names, in order, without repeats."""
    found: dict[str, None] = {}
    end = 0
    for candidate in _CANDIDATE.finditer(text[:LONGEST_TEXT]):
        if candidate.start() < end:
            continue  # inside the one before, as the path of a file URI
        token = candidate[1][: LONGEST_PATH + 1]
        end = candidate.start() + len(token)
        if _NO_PATH.match(token):
            continue
        token = _JOINED.sub("", bare(token))
        short = _EXTENDED.match(token)
        path = absolute_path(short[0] if short else token)
        if path and path != "/":
            found.setdefault(path)
    return list(found)


@F.pandas_udf(ArrayType(StringType()))
def text_paths(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: paths_in(t) if t else [])


# -- evidence of tool calls ----------------------------------------------------------------------------

# Keys whose strings are paths, and keys that name a tool.
PATH_KEYS = ("path", "file", "file_path", "filePath", "filename", "cwd", "workdir", "directory", "root")
TOOL_KEYS = ("name", "tool_name", "toolName", "tool")
SERVER_KEYS = ("server", "server_name", "serverName", "namespace")
_PATCH = re.compile(r"^\*\*\* (?:(?:Update|Add|Delete) File|Move to|Copy to): (.+?)\s*$", re.M)


def strings_of(value, depth: int = DEEPEST) -> Iterator[str]:
    """All strings of a JSON value in order, ``depth`` levels deep; strings that hold JSON themselves count as one more level."""
    if isinstance(value, str):
        inner = None
        if depth > 0 and value[:1] in ("{", "["):
            try:
                inner = json.loads(value)
            except ValueError:
                inner = None
        if isinstance(inner, (dict, list)):
            yield from strings_of(inner, depth - 1)
        else:
            yield value
    elif depth > 0 and isinstance(value, (dict, list)):
        for part in value.values() if isinstance(value, dict) else value:
            yield from strings_of(part, depth - 1)


def fields_of(value, keys=PATH_KEYS, depth: int = DEEPEST) -> Iterator[str]:
    """The strings that stand under one of ``keys`` at any level of a JSON value."""
    if depth <= 0 or not isinstance(value, (dict, list)):
        return
    for key, part in value.items() if isinstance(value, dict) else ((None, v) for v in value):
        if key in keys:
            yield from strings_of(part, depth - 1)
        else:
            yield from fields_of(part, keys, depth - 1)


def patch_paths(text: str) -> list[str]:
    """The files that the headers of a patch name."""
    return list(dict.fromkeys(p for p in map(absolute_path, _PATCH.findall(text)) if p))


def _said(value) -> list[str]:
    """The paths of all strings of a value; a string that is a path as a whole is that one."""
    out: list[str] = []
    for text in strings_of(value):
        whole = _whole(text)
        out += [whole] if whole else paths_in(text)
    return out


def _whole(text: str) -> str | None:
    """The path that a string is as a whole."""
    path = absolute_path(text)
    return path if path and bare(text) == text else None


def _prompted(text: str) -> list[str]:
    """The paths of a message that holds nothing but one path a line."""
    lines = [line.strip() for line in text.strip().splitlines() if line.strip()]
    paths = [_whole(line) for line in lines]
    return paths if paths and all(paths) else []


@dataclass(frozen=True)
class Rule:
    """Where events of a kind name paths, and what that is evidence of.

    ``kind`` is the type of the event, with that of its payload behind a slash
    for the two that carry others; ``*`` stands for all types that no rule and
    none of SILENT names. ``at`` are places in the event, or in each member of
    the list at ``each``. ``where`` asks for values at places (in lower case,
    without underscores). Of rules with one ``turn`` the first that finds
    something counts.
    """

    kind: str
    at: tuple[str, ...]
    read: str
    source: str
    confidence: str
    where: tuple[tuple[str, str], ...] = ()
    each: str = ""
    searched: bool | None = None
    turn: str = ""


# Event types that are no evidence where no rule names them.
SILENT = ("session_meta", "turn_context", "world_state", "compacted", "response_item", "event_msg")
_USER = ("^payload.role", "user")
_CALL, _CUSTOM, _ITEM = "response_item/function_call", "response_item/custom_tool_call", "event_msg/item_completed"
RULES = (
    Rule("response_item/message", ("text",), "listed", "prompt", "high", (_USER, ("type", "inputtext")), "payload.content", turn="typed"),
    Rule("response_item/message", ("text",), "inside", "user-provided", "medium", (_USER, ("type", "inputtext")), "payload.content", turn="typed"),
    Rule("response_item/message", ("",), "said", "user-provided", "medium", (_USER, ("type", "inputimage")), "payload.content"),
    Rule(_CALL, ("payload.arguments",), "said", "search-tool", "high", searched=True),
    Rule(_CALL, ("payload.arguments",), "said", "other-tool", "high", (("tool", "shellcommand"),), searched=False),
    Rule(_CUSTOM, ("payload.input",), "patch", "other-tool", "high", (("tool", "applypatch"),)),
    Rule(_CUSTOM, ("payload.input",), "said", "other-tool", "high", (("tool", "exec"),)),
    Rule(_ITEM, ("payload.item",), "changed", "other-tool", "high", (("payload.item.type", "filechange"),)),
    Rule(_ITEM, ("payload.item.command", "payload.item.parsed_cmd"), "said", "other-tool", "high", (("payload.item.type", "commandexecution"),)),
    Rule(_ITEM, ("payload.item.arguments", "payload.item.input"), "said", "search-tool", "high", (("payload.item.type", "mcptoolcall"),), searched=True),
    Rule("*", ("message", "text", "payload.message", "payload.text"), "said", "user-provided", "low"),
)


def _changed(values: list) -> list[str]:
    """The paths of file changes: values of path fields, and the names under ``changes``."""
    out: list[str] = []
    for item in filter(lambda v: isinstance(v, dict), values):
        changes = item.get("changes") if isinstance(item.get("changes"), dict) else {}
        out += [*fields_of({k: v for k, v in item.items() if k != "changes"}), *changes]
    return [p for p in map(absolute_path, out) if p]


READERS: dict[str, Callable[[list], list[str]]] = {
    "said": lambda values: [p for v in values for p in _said(v)],
    "inside": lambda values: [p for v in values if isinstance(v, str) for p in paths_in(v)],
    "listed": lambda values: [p for v in values if isinstance(v, str) for p in _prompted(v)],
    "patch": lambda values: [p for v in values for text in strings_of(v) for p in patch_paths(text)],
    "changed": _changed,
}


def _at(record, place: str):
    """The value at a place of nested records; None where there is none."""
    for name in filter(None, place.split(".")):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _plain(value) -> str:
    return str(value or "").replace("_", "").lower()


def _searched(event: dict, tools: tuple) -> bool:
    """Whether a tool or server of the event is one that searches."""
    held = [r for r in (_at(event, "payload.item"), event.get("payload"), event) if isinstance(r, dict)]
    named = [v.lower() for r in held for k, v in r.items() if k in SERVER_KEYS and isinstance(v, str)]
    return any(name == t or name.startswith(f"mcp__{t}") for t in tools for name in (*named, _tool(event)))


def _tool(event: dict) -> str:
    held = [r for r in (event.get("payload"), event) if isinstance(r, dict)]
    return next((r[k].lower() for r in held for k in TOOL_KEYS if isinstance(r.get(k), str)), "")


def evidence_of(line: str, search_tools: tuple = ("document_search",)) -> list[tuple[str, str, str, str]]:
    """(path, source, confidence, event type) of each path that one JSON line of a session gives evidence of, by RULES."""
    try:
        event = json.loads(line) if len(line) <= LONGEST_LINE else None
    except ValueError:
        event = None
    if not isinstance(event, dict):
        return []
    inner = _at(event, "payload.type")
    kind = str(event.get("type")) + (f"/{inner}" if event.get("type") in ("response_item", "event_msg") and isinstance(inner, str) else "")
    searched, tool = _searched(event, search_tools), _tool(event)
    found: dict[tuple, None] = {}
    for group, rules in groupby((r for r in RULES if r.kind == kind or r.kind == "*" and not kind.startswith(SILENT)), key=lambda r: (r.turn, r.each)):
        rules = list(rules)
        members = _at(event, group[1]) if group[1] else [event]
        for member in members if isinstance(members, list) else []:
            for rule in rules:
                held = {"tool": tool, **{p: _at(event, p[1:]) if p[0] == "^" else _at(member, p) for p, _ in rule.where if p != "tool"}}
                if rule.searched not in (None, searched) or any(_plain(held[p]) != want for p, want in rule.where):
                    continue
                values = [v for v in (_at(member, p) for p in rule.at) if v is not None]
                told = [(path, rule.source, rule.confidence, kind) for path in READERS[rule.read](values)]
                found.update(dict.fromkeys(told))
                if told and rule.turn:
                    break
    return list(found)


def evidence(lines: DataFrame, search_tools: tuple = ("document_search",)) -> DataFrame:
    """(session, line, path, source, confidence, event_type) of JSON lines (session, line, value), for references()."""
    shape = "array<struct<path: string, source: string, confidence: string, event_type: string>>"

    @F.pandas_udf(shape)
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [dict(zip(("path", "source", "confidence", "event_type"), e)) for e in evidence_of(v, search_tools)] if v else [])

    return lines.select("session", "line", F.explode(read("value")).alias("e")).select("session", "line", "e.*")


def existence(paths: list[str], look: Callable[[str], str | None], seconds: float = 0.3, at_once: int = 8) -> dict[str, tuple[str, str | None]]:
    """For each path of one page (file, folder, missing or unknown, why unknown); ``look`` gives file, folder or None.

    Shares of other machines are never asked; a look that takes longer than
    ``seconds`` or fails is unknown. At most ``at_once`` looks run together.
    """
    asked = [p for p in dict.fromkeys(paths) if not p.startswith(("\\\\", "//"))]
    out = {p: ("unknown", "network") for p in paths if p not in asked}
    pool = ThreadPoolExecutor(at_once)
    try:
        for start in range(0, len(asked), at_once):
            for path, answer in [(p, pool.submit(look, p)) for p in asked[start : start + at_once]]:
                try:
                    out[path] = (answer.result(seconds) or "missing", None)
                except Expired:
                    out[path] = ("unknown", "timeout")
                except OSError as problem:
                    out[path] = ("unknown", type(problem).__name__)
            if any(out[p][1] == "timeout" for p in asked[start : start + at_once]):
                out |= {p: ("unknown", "timeout") for p in asked[start + at_once :]}
                break
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return {p: out[p] for p in paths}


def events_of_lines(lines: DataFrame) -> DataFrame:
    """Parses JSON lines (session, line, value): type, role, text, time; lines that are no JSON objects or too long are invalid."""
    fields = "type string, timestamp string, role string, text string, payload struct<type: string, role: string, text: string, timestamp: string>"
    parsed = F.when(F.length("value") <= LONGEST_LINE, F.from_json("value", fields))
    rows = lines.filter(F.trim("value") != "").withColumn("e", parsed).withColumn("valid", F.coalesce(F.length("value") <= LONGEST_LINE, F.lit(False)) & F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) is not null"))
    kind = F.coalesce("e.type", F.lit("unknown"))
    kind = F.when(kind.isin("response_item", "event_msg", "response") & F.col("e.payload.type").isNotNull(), F.concat_ws("/", kind, "e.payload.type")).otherwise(kind)
    return rows.select(
        "session", "line", "valid", F.when(F.col("valid"), kind).alias("event_type"), F.coalesce("e.role", "e.payload.role").alias("role"),
        F.coalesce("e.text", "e.payload.text").alias("text"), F.coalesce("e.timestamp", "e.payload.timestamp").alias("time"),
    )


def session_summary(events: DataFrame) -> DataFrame:
    """Per session: events, invalid lines, first and last time by line, the histogram of event types."""
    valid = F.col("valid")
    heads = events.groupBy("session").agg(
        F.sum(valid.cast("long")).alias("events"), F.sum((~valid).cast("long")).alias("invalid_lines"),
        F.min_by("time", F.when(F.col("time").isNotNull(), F.col("line"))).alias("started_at"), F.max_by("time", F.when(F.col("time").isNotNull(), F.col("line"))).alias("last_event_at"),
    )
    kinds = events.filter(valid).groupBy("session", "event_type").agg(F.count("*").alias("n")).groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string")))), ",").alias("event_types"))
    return heads.join(kinds, "session", "left")


def references(evidence: DataFrame) -> DataFrame:
    """One row for each (session, path) of ``evidence`` (session, path, source, confidence, event_type).

    The main source is the one with the highest confidence, then the first by priority.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CONFIDENCES) for x in (c, i)]), F.col("confidence"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SOURCES) for x in (s, i)]), F.col("source"))
    rows = evidence.withColumn("rank", rank).withColumn("place", place)
    return rows.groupBy("session", "path").agg(
        F.count("*").alias("occurrences"), F.max_by("source", F.struct("rank", -F.col("place"))).alias("source"), F.max_by("confidence", "rank").alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("place", "source"))), lambda x: x["source"]), ",").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("event_types"),
    )


def indexed_references(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """References with the document they name: by exact path, else by path in any case (the smallest id)."""
    exact = docs.select(F.col("path").alias("p"), F.col("id").alias("exact_id"))
    folded = docs.groupBy(F.lower("path").alias("q")).agg(F.min("id").alias("folded_id"))
    out = refs.join(exact, refs["path"] == exact["p"], "left").join(folded, F.lower(refs["path"]) == folded["q"], "left")
    return out.withColumn("document_id", F.coalesce("exact_id", "folded_id")).withColumn("indexed", F.col("document_id").isNotNull()).drop("p", "q", "exact_id", "folded_id")


def reference_buckets(refs: DataFrame) -> DataFrame:
    """Per session the references that are shown at once, those of low confidence and those whose ``state`` is unknown.

    A reference is in one of them only: unknown before low; ``state`` (optional) is the answer of existence().
    """
    unknown = F.col("state") == "unknown" if "state" in refs.columns else F.lit(False)
    bucket = F.when(unknown, "unknown").when(F.col("confidence") == "low", "low").otherwise("visible")
    counted = [F.sum((F.col("bucket") == b).cast("long")).alias(f"n_{b}") for b in ("visible", "low", "unknown")]
    return refs.withColumn("bucket", bucket).groupBy("session").agg(*counted)


def reference_totals(refs: DataFrame) -> DataFrame:
    """Per session the number of references, of those in the index, and of those of each source."""
    return refs.groupBy("session").agg(F.count("*").alias("n_references"), F.sum(F.col("indexed").cast("long")).alias("n_indexed"), *[F.sum(F.array_contains(F.split("sources", ","), s).cast("long")).alias("n_" + s.replace("-", "_")) for s in SOURCES])
