"""Log lines of several programs into records of time, level, component, message.

A deterministic character-level machine reads the opening of a line: its first
character selects the layouts that are possible, and each layout is a short
grammar of steps (a timestamp, a level, blanks, a bracket, a name) walked one
character at a time. Openings that are no proof by themselves put the machine into a
lookahead state: an object or a named time must show one more known name on its line,
and an object spread over lines must show one within the next ``AHEAD`` lines. A line
that opens with no layout continues the entry above.

Attachment is relational: line states, then the lookahead, then the last header line at
or before each line, computed over bounded blocks of line numbers with a carry per
block, so a run of any length never sits in one task. A block also sees the first
``AHEAD`` lines of the next one, so its edges change nothing. Only the lines of one
entry meet, since its message is one value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

BLOCK = 4096
"""Line numbers per block of the attachment step."""
AHEAD = 16
"""Line numbers that the lookahead reaches."""

_NO_RUN = "n"
# Level words in use, by their upper case.
LEVELS = {
    "TRACE": "TRACE", "T": "TRACE", "VERBOSE": "TRACE",
    "DEBUG": "DEBUG", "D": "DEBUG",
    "INFO": "INFO", "I": "INFO", "INFORMATION": "INFO", "NOTICE": "INFO",
    "WARN": "WARN", "W": "WARN", "WARNING": "WARN",
    "ERROR": "ERROR", "E": "ERROR", "ERR": "ERROR",
    "FATAL": "FATAL", "F": "FATAL", "CRITICAL": "FATAL", "CRIT": "FATAL",
}
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp")
LEVEL_KEYS = ("level", "lvl", "severity")
COMPONENT_KEYS = ("component", "comp")
MESSAGE_KEYS = ("message", "msg")

# Layouts: first characters, then steps. <...> is a timestamp, L a level word, l a
# level letter, C a component, 9 digits, _ one or more blanks, w a word, p a number in
# brackets that may be absent; the rest stands for itself.
GRAMMARS = (
    ("letter", "TDIWEF", ("l", "<YMD h:m:s.f>", "_", "9", "_", "C]", "]")),
    ("bars", "0123456789", ("<D.M.Y h:m:s.f>", " | ", "L", " | ", "C ", " | ")),
    ("bracket", "0123456789", ("<Y-M-D h:m:s,f>", "_", "L", "_", "[", "C]", "]")),
    ("colon", "0123456789", ("<Y-M-DTh:m:s.fz>", "_", "L", "_", "C ", ": ")),
    ("slashes", "[", ("<[D/N/Y:h:m:s z]>", "_", "(", "C)", ")", "_", "L", ":")),
    ("tag", "[", ("[", "C]", "]")),
    ("dashes", "-", ("--- ", "C:", ":")),
    ("plain", "0123456789", ("<Y-M-D h:m:s.fz>", "_", "L", "_", "C ", ": ")),
    ("fields", "0123456789", ("<Y-M-D h:m:s,f>", " - ", "C ", " - ", "L", " - ")),
    ("system", "JFMASOND", ("<N d h:m:s>", "_", "w", "_", "C:", "p", ":")),
)
LAYOUTS = (*(g[0] for g in GRAMMARS), "pairs", "object")
CONTINUES, ASKS, UNKNOWN_TIME = -1, -2, -3
"""States of a line that opens with no layout: it continues, it is a header if the
lookahead answers, it continues but opens like a timestamp."""
_WIDTH = {"Y": 4, "M": 2, "D": 2, "h": 2, "m": 2, "s": 2}


def _days(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01 of a valid date."""
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if not 1 <= m <= 12 or not 1 <= d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]:
        return None
    y, m = (y - 1, m + 9) if m < 3 else (y, m - 3)
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * m + 2) // 5 + d - 1 - 719468


def read_time(s: str, i: int, form: str) -> tuple[int, int] | None:
    """Read a timestamp of the given form at ``i``: microseconds since 1970 in UTC
    and the next position, or None. f is a fraction of 1-9 digits and may be absent
    with the mark before it; z is Z or an offset and may be absent; d is a day padded
    with a blank. A form without a year has no time: -1."""
    v = {"M": 1, "D": 1, "Y": 0, "h": 0, "m": 0, "s": 0}
    micros, offset, n, k = 0, 0, len(s), 0
    while k < len(form):
        c = form[k]
        if c in _WIDTH:
            w = _WIDTH[c]
            part = s[i : i + w]
            if len(part) < w or not (part.isascii() and part.isdigit()):
                return None
            v[c] = int(part)
            i += w
        elif c == "N":
            if s[i : i + 3] not in MONTHS:
                return None
            v["M"] = MONTHS[s[i : i + 3]]
            i += 3
        elif c == "d":
            j = i + (s[i : i + 1] == " ")
            w = 2 if s[j : j + 2].isascii() and s[j : j + 2].isdigit() else 1
            if not (s[j : j + w].isascii() and s[j : j + w].isdigit()):
                return None
            v["D"], i = int(s[j : j + w]), j + w
        elif k + 1 < len(form) and form[k + 1] == "f":
            j = i + 1
            while j < n and j - i <= 9 and "0" <= s[j] <= "9":
                j += 1
            if i < n and s[i] == c and j > i + 1:
                micros = int(s[i + 1 : j].ljust(6, "0")[:6])
                i = j
            k += 1
        elif c == "z":
            if i < n and s[i] in "Zz":
                i += 1
            elif i < n and s[i] in "+-":
                hh = s[i + 1 : i + 3]
                j = i + 4 if s[i + 3 : i + 4] == ":" else i + 3
                mm = s[j : j + 2]
                if not (len(hh) == len(mm) == 2 and (hh + mm).isascii() and (hh + mm).isdigit()):
                    return None
                offset = (int(hh) * 60 + int(mm)) * (-1 if s[i] == "-" else 1)
                i = j + 2
        else:
            if i >= n or s[i] != c:
                return None
            i += 1
        k += 1
    dated = "Y" in form
    days = _days(v["Y"] if dated else 2000, v["M"], v["D"])
    if days is None or v["h"] > 23 or v["m"] > 59 or v["s"] > 60:
        return None
    seconds = days * 86400 + v["h"] * 3600 + v["m"] * 60 + v["s"] - offset * 60
    return (seconds * 1_000_000 + micros if dated else -1), i


def _walk(s: str, steps: tuple[str, ...]) -> tuple[int, str, str, int] | None:
    """Walk one layout from the first column: time, level, component, where the message begins."""
    i, n, ts, level, component = 0, len(s), -1, "", ""
    for step in steps:
        head = step[0]
        if head == "<":
            got = read_time(s, i, step[1:-1])
            if got is None:
                return None
            ts, i = got
        elif step == "_":
            j = i
            while j < n and s[j] == " ":
                j += 1
            if j == i:
                return None
            i = j
        elif step == "l":
            level = LEVELS[s[i]]
            i += 1
        elif step == "L":
            j = i
            while j < n and s[j].isalpha():
                j += 1
            level = LEVELS.get(s[i:j].upper(), "")
            if not level:
                return None
            i = j
        elif step == "9":
            j = i
            while j < n and "0" <= s[j] <= "9":
                j += 1
            if j == i:
                return None
            i = j
        elif step == "w":
            j = i
            while j < n and not s[j].isspace():
                j += 1
            if j == i:
                return None
            i = j
        elif step == "p":
            if s.startswith("[", i):
                j = s.find("]", i)
                if not (s[i + 1 : j].isascii() and s[i + 1 : j].isdigit()):
                    return None
                i = j + 1
        elif head == "C":
            stop, j = step[1], i
            if i >= n or not (s[i].isalpha() or s[i] == "_"):
                return None
            # a name begins with a letter and has no blanks; one that ends at a colon may hold doubled colons
            while j < n and not s[j].isspace() and s[j] not in "[](){}|\"=,;" and (s[j] != stop):
                j += 1
            if stop == " " and steps[-1] == ": ":
                if j - i < 2 or s[j - 1] != ":":
                    return None
                j -= 1
            if j == i:
                return None
            component, i = s[i:j], j
        else:
            # separators of several blanks are read as written or padded
            want = step.strip(" ")
            if step[0] == " ":
                if i >= n or s[i] != " ":
                    return None
                while i < n and s[i] == " ":
                    i += 1
            if not s.startswith(want, i):
                return None
            i += len(want)
            if step[-1] == " " and i < n:
                if s[i] not in " \t\r":
                    return None
                i += 1
                while i < n and s[i] == " ":
                    i += 1
    return ts, level, component, i


_NAMES = "|".join((*TIME_KEYS, *LEVEL_KEYS, *COMPONENT_KEYS, *MESSAGE_KEYS))
_NAMED = re.compile(rf'"(?:{_NAMES})"\s*:')
_PAIRED = re.compile(rf"\s(?:{_NAMES})=")
_LIKE_TIME = re.compile(r"\[?[0-9]{2,4}[-/.][0-9A-Za-z]{2,3}[-/.][0-9]{2,4}[ T:][0-9]{1,2}:[0-9]{2}|[A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}")


def _pair_time(s: str) -> bool:
    """Whether a line opens with a named time, key=value, that is a time or is followed by a known name."""
    k = s.find("=", 0, 12)
    if k <= 0 or s[:k] not in TIME_KEYS:
        return False
    value = s[k + 1 :].split(None, 1)[:1]
    return _PAIRED.search(s) is not None or _any_time(value[0].strip('"') if value else "") >= 0


def line_state(s: str) -> int:
    """The index in ``LAYOUTS`` of the layout with which a line (colour codes removed) opens
    an entry in its first column; else ``CONTINUES``, ``ASKS`` or ``UNKNOWN_TIME``."""
    if not s:
        return CONTINUES
    c = s[0]
    if c == "{":
        rest = s[1:].strip()
        if rest and rest[0] != '"':
            return CONTINUES
        if _NAMED.search(rest):
            return len(LAYOUTS) - 1
        return CONTINUES if rest.endswith("}") else ASKS
    if c in " \t|":
        return CONTINUES
    for k, (_, first, steps) in enumerate(GRAMMARS):
        if c in first and _walk(s, steps) is not None:
            return k
    if _pair_time(s):
        return len(LAYOUTS) - 2
    return UNKNOWN_TIME if _LIKE_TIME.match(s) else CONTINUES


def line_event(s: str, state: int) -> int:
    """What a line says to an object opened above: 1 it is a program's record (a known name
    opens the line), 2 it ends here or another entry begins, 0 nothing."""
    if state >= 0 or state == ASKS or s.startswith("}"):
        return 2
    return 1 if _NAMED.match(s.lstrip()) else 0


def is_header(s: str) -> bool:
    """Whether a line (colour codes removed) by itself opens an entry in its first column."""
    return line_state(s) >= 0


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _string(s: str, i: int) -> tuple[str, int]:
    """Read a quoted string whose quote is at ``i``, unescaped, and the position after
    it. One that never closes reaches to the end of the entry."""
    out, j, n = [], i + 1, len(s)
    while j < n:
        q, b = s.find('"', j), s.find("\\", j)
        if b < 0 or 0 <= q < b:
            if q < 0:
                break
            out.append(s[j:q])
            return "".join(out), q + 1
        out.append(s[j:b])
        e = s[b + 1 : b + 2]
        if e == "u" and len(s) >= b + 6:
            try:
                code = int(s[b + 2 : b + 6], 16)
                j = b + 6
                if 0xD800 <= code < 0xDC00 and s[j : j + 2] == "\\u":
                    code = 0x10000 + ((code - 0xD800) << 10) + (int(s[j + 2 : j + 6], 16) - 0xDC00)
                    j += 6
                out.append(chr(code) if not 0xD800 <= code < 0xE000 else "�")
                continue
            except ValueError:
                pass
        out.append(_ESCAPES.get(e, e))
        j = b + 2
    out.append(s[j:])
    return "".join(out), n


def _object(s: str) -> tuple[dict[str, str], int]:
    """Named values of the outermost object at the start of ``s``; where it ends."""
    found: dict[str, str] = {}
    i, n, depth, key = 0, len(s), 0, None
    value = False
    while i < n:
        c = s[i]
        if c == '"':
            text, i = _string(s, i)
            if depth == 1:
                if value:
                    found.setdefault(key or "", text)
                    value = False
                else:
                    key = text
            continue
        if c in "{[":
            depth += 1
            value = value and depth == 1
        elif c in "}]":
            depth -= 1
            value = False
            if depth <= 0:
                return found, i + 1
        elif c == ":" and depth == 1:
            value = True
        elif c == ",":
            value = False
        elif value and depth == 1 and not c.isspace():
            j = i
            while j < n and s[j] not in ",}] \t\r\n":
                j += 1
            found.setdefault(key or "", "" if s[i:j] == "null" else s[i:j])
            value = False
            i = j
            continue
        i += 1
    return found, n


def _pairs(s: str) -> tuple[dict[str, str], int]:
    """key=value pairs up to the first line end outside quotes."""
    found: dict[str, str] = {}
    i, n = 0, len(s)
    while i < n and s[i] != "\n":
        if s[i] in " \t\r":
            i += 1
            continue
        j = i
        while j < n and s[j] not in "= \t\r\n":
            j += 1
        if j < n and s[j] == "=":
            key = s[i:j]
            if s[j + 1 : j + 2] == '"':
                text, j = _string(s, j + 1)
            else:
                i = j = j + 1
                while j < n and s[j] not in " \t\r\n":
                    j += 1
                text = s[i:j]
            found.setdefault(key, text)
        i = max(j, i + 1) if j == i else j
    return found, i


def _pick(found: dict[str, str], keys: tuple[str, ...]) -> str:
    return next((found[k] for k in keys if k in found), "")


def _any_time(text: str) -> int:
    """A named time: a date with time, or a count since 1970 in s, ms, us or ns."""
    if text.isascii() and text.isdigit() and len(text) <= 19:
        x = int(text)
        return x * 1_000_000 if x < 10**11 else x * 1000 if x < 10**14 else x if x < 10**17 else x // 1000
    got = read_time(text, 0, "Y-M-DTh:m:s.fz") or read_time(text, 0, "Y-M-D h:m:s.fz")
    return got[0] if got else -1


def parse_entry(text: str) -> tuple[int, str, str, str]:
    """Time, level, component and message of an entry: its lines joined by line feeds."""
    if text.startswith("{"):
        found, at = _object(text)
    elif _pair_time(text):
        found, at = _pairs(text)
    else:
        for _, first, steps in GRAMMARS:
            if text[:1] in first and text:
                got = _walk(text.split("\n", 1)[0], steps)
                if got is not None:
                    ts, level, component, at = got
                    return ts, level, component, " ".join(text[at:].split())
        return -1, "", "", " ".join(text.split())
    level = LEVELS.get(_pick(found, LEVEL_KEYS).upper(), "")
    message = _pick(found, MESSAGE_KEYS) + "\n" + text[at:]
    return _any_time(_pick(found, TIME_KEYS)), level, _pick(found, COMPONENT_KEYS), " ".join(message.split())


@F.pandas_udf(IntegerType())
def _states(texts: pd.Series) -> pd.Series:
    """Four times the state, plus the event."""
    out = [4 * (k := line_state(x)) + line_event(x, k) if x else 4 * CONTINUES for x in texts]
    return pd.Series(out, dtype="int32")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [parse_entry(x) for x in b["__text"]]
        yield pd.DataFrame(
            {
                "run_id": [None if x == _NO_RUN else x[1:] for x in b["__run"]],
                "line_no": b["__entry"],
                "ts_us": pd.Series([g[0] for g in got], dtype="int64"),
                "level": [g[1] for g in got],
                "component": [g[2] for g in got],
                "message": [g[3] for g in got],
            }
        )


def _placed(df: DataFrame, run: str, line_no: str, order: str, raw: str) -> DataFrame:
    """Every line once, by run and block, with its state: __run, __block, __no, __text, __state."""
    text = F.regexp_replace(F.coalesce(F.col(raw).cast("string"), F.lit("")), "\u001b\\[[0-9;?]*[A-Za-z]", "")
    # a run's name is kept behind a letter, so that the key is never null and plain joins do
    no = F.col("__no").cast("long")
    lines = df.select(
        F.coalesce(F.concat(F.lit("r"), F.col(run).cast("string")), F.lit(_NO_RUN)).alias("__run"),
        F.col(line_no).cast("int").alias("__no"),
        F.col(order).cast("long").alias("__ord"),
        text.alias("__text"),
    ).where(no.isNotNull())
    block = F.floor(no / BLOCK)
    # the first lines of a block are seen from the block before
    seen = F.when(F.pmod(no, F.lit(BLOCK)) < AHEAD, F.array(block, block - 1)).otherwise(F.array(block))
    once = (
        lines.withColumn("__block", F.explode(seen))
        .groupBy("__run", "__block", "__no")
        .agg(F.min(F.struct("__ord", "__text")).alias("__m"))
        .select("__run", "__block", "__no", F.col("__m.__text").alias("__text"))
    )
    near = Window.partitionBy("__run", "__block").orderBy("__no").rangeBetween(1, AHEAD)
    code = once.withColumn("__code", _states("__text"))
    event = F.pmod("__code", F.lit(4))
    answered = F.pmod(F.min(F.when(event > 0, no * 4 + event)).over(near), F.lit(4)) == 1
    state = F.floor(F.col("__code") / 4)
    confirmed = F.when((state == ASKS) & answered, F.lit(len(LAYOUTS) - 1)).otherwise(state)
    return code.withColumn("__state", confirmed).where(F.col("__block") == block).drop("__code")


def line_kinds(df: DataFrame, run: str = "run_id", line_no: str = "line_no", order: str = "line_id", raw: str = "raw") -> DataFrame:
    """Lines by what opens them: kind (a layout, ``continues``, or ``unknown time``: a line that
    continues but looks like the header of a program unknown here) and n_lines."""
    names = F.create_map(*[F.lit(x) for k, v in [*enumerate(LAYOUTS), (CONTINUES, "continues"), (ASKS, "continues"), (UNKNOWN_TIME, "unknown time")] for x in (k, v)])
    x = _placed(df, run, line_no, order, raw).select(names[F.col("__state").cast("int")].alias("kind"))
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("n_lines"))


def log_entries(df: DataFrame, run: str = "run_id", line_no: str = "line_no", order: str = "line_id", raw: str = "raw") -> DataFrame:
    """One row (run_id, line_no, ts_us, level, component, message) per log entry.

    Lines of a run count in line_no order; of lines with one number the one with
    the smallest ``order`` counts. Lines before a run's first header belong to no
    entry. A null raw is a blank line; rows with null line_no have no place and
    are left out; null runs form one run. ts_us is -1 and level '' where the
    layout has none. Other columns are not looked at. Lines that look like the header
    of an unknown program continue the entry above; ``line_kinds`` counts them.
    """
    inside = Window.partitionBy("__run", "__block").orderBy("__no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("__state") >= 0, F.col("__no"))
    placed = _placed(df, run, line_no, order, raw).withColumn("__here", F.max(head).over(inside)).drop("__state")
    earlier = Window.partitionBy("__run").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # counting the text keeps it in this branch, so both branches read one and the same shuffle
    last = F.when(F.col("__n") >= 0, F.col("__last"))
    carry = (
        placed.groupBy("__run", "__block")
        .agg(F.max("__here").alias("__last"), F.count("__text").alias("__n"))
        .select("__run", "__block", F.max(last).over(earlier).alias("__carry"))
    )
    entries = (
        placed.join(carry, ["__run", "__block"])
        .withColumn("__entry", F.coalesce("__here", "__carry"))
        .where(F.col("__entry").isNotNull())
        .groupBy("__run", "__entry")
        .agg(F.sort_array(F.collect_list(F.struct("__no", "__text"))).alias("__lines"))
        .select("__run", "__entry", F.array_join(F.col("__lines.__text"), "\n").alias("__text"))
    )
    return entries.mapInPandas(
        _records, "run_id string, line_no int, ts_us long, level string, component string, message string"
    )
