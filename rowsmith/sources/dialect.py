"""Splitting and quoting of delimited text, in the dialects simple, quoted, quoted_rfc, whitespace and monocolumn."""

from __future__ import annotations

import re

from ..errors import HandlingError

#: The dialects that are tried, in this order.
DIALECTS = (("\t", "simple"), (",", "quoted"), (";", "quoted"), ("|", "simple"))
POLICIES = ("simple", "quoted", "quoted_rfc", "whitespace", "monocolumn")


def delimiter(text: str) -> str:
    return "\t" if text in ("TAB", "\\t") else text


def default_policy(delim: str) -> str:
    return "quoted" if delim in (",", ";") else "whitespace" if delim == " " else "simple"


def check(delim: str, policy: str) -> None:
    if policy not in POLICIES:
        raise HandlingError(f'Unknown policy "{policy}"')
    if policy == "whitespace" and delim != " ":
        raise HandlingError('Only the space can be the delimiter of the "whitespace" policy')
    if delim == '"' and policy in ("quoted", "quoted_rfc"):
        raise HandlingError("The double quote can't be the delimiter of a quoted policy")


def split_quoted(line: str, delim: str, keep: bool = False) -> tuple[list[str], bool]:
    """Fields of a line and whether a quote stands where none may. ``keep``: leave quotes and spaces in place."""
    if '"' not in line:
        return line.split(delim), False
    fields, at, warn = [], 0, False
    pad = "" if delim == " " else " *"
    quoted = re.compile(rf'{pad}"((?:[^"]|"")*)"{pad}(?={re.escape(delim)}|$)')
    while True:
        m = quoted.match(line, at)
        if m:
            fields.append(m[0] if keep else m[1].replace('""', '"'))
            end = m.end()
        else:
            end = line.find(delim, at)
            end = len(line) if end < 0 else end
            fields.append(line[at:end])
            warn |= '"' in fields[-1]
        if end >= len(line):
            return fields, warn
        at = end + len(delim)


def split(line: str, delim: str, policy: str, keep: bool = False) -> tuple[list[str], bool]:
    if policy == "simple":
        return line.split(delim), False
    if policy == "whitespace":
        return (re.findall(" *[^ ]+ *", line) if keep else [f for f in line.split(" ") if f]), False
    if policy == "monocolumn":
        return [line], False
    return split_quoted(line, delim, keep)


def unquote(field: str) -> str:
    m = re.fullmatch(r' *"((?:[^"]|"")*)" *', field)
    return m[1].replace('""', '"') if m else field


def quote(field: str, delim: str, policy: str) -> str:
    special = (delim, '"', "\n", "\r") if policy == "quoted_rfc" else (delim, '"')
    if policy in ("quoted", "quoted_rfc") and any(s in field for s in special):
        return '"' + field.replace('"', '""') + '"'
    return field


def records(lines: list[str], comment_prefix: str | None = None) -> list[str]:
    """Join physical lines until quotes balance; lines that start a record with the prefix are left out."""
    out, open_, odd = [], [], 0
    for line in lines:
        if comment_prefix and not open_ and line.startswith(comment_prefix):
            continue
        open_.append(line)
        odd ^= line.count('"') & 1
        if not odd:
            out.append("\n".join(open_))
            open_ = []
    if open_:
        raise HandlingError("Inconsistent double quote escaping: a quote is never closed")
    return out


def guess_ends(head: list[str], tail: list[str], name: str = "", least: int = 5) -> tuple[str, str] | None:
    """A dialect from a file's first and last lines, at least ``least`` of them.

    Without one that fits all lines: of a ``.csv`` file with fewer lines one that fits those, then the most frequent
    delimiter; of a ``.tsv`` file the tab.
    """
    lines = [*head, *tail]
    if found := guess(lines, least=least):
        return found
    if name.endswith(".csv"):
        text = "\n".join(lines)
        counts = {d: text.count(d[0]) for d in DIALECTS}
        short = guess(lines) if len(lines) <= least else None
        return short or (max(counts, key=counts.get) if any(counts.values()) else (",", "quoted"))
    return ("\t", "simple") if name.endswith(".tsv") else None


def guess(lines: list[str], name: str = "", least: int = 2) -> tuple[str, str] | None:
    """The first dialect in which all lines have the same number of fields, two or more; else by the file's ending."""
    lines = [x for x in lines if x]
    if len(lines) >= least:
        for delim, policy in DIALECTS:
            parts = [split(x, delim, policy) for x in lines]
            if len({len(p) for p, _ in parts}) == 1 and len(parts[0][0]) > 1 and not any(w for _, w in parts):
                return delim, policy
    if name.endswith(".csv"):
        counts = {d: sum(x.count(d) for x in lines) for d in (",", ";")}
        return max(counts, key=counts.get), "quoted"
    return ("\t", "simple") if name.endswith(".tsv") else None
