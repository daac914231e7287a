"""Declarations seen by blocks: a scanner per language family keeps a stack of what is open.

Strings and comments are blanked first, so brackets in them count for nothing. Then one pass over the brackets
(or, in Python, the indents) closes and opens blocks; the text between two borders is the head of a
block, over as many lines as it takes. Owners and extents come from the stack, not from the nearest line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The table that every extractor of symbols gives: built-in lines, blocks, or one of the user's own.
SYMBOLS = ("file_name string, language string, kind string, name string, owner string, line int, end_line int, "
           "mods string, rtype string, params string, bases string")

_STRING = r'"(?:\\.|[^"\\\n])*"?'
_CHAR = r"'(?:\\.|[^'\\\n])'"
_QUOTED = r"'(?:\\.|[^'\\\n])*'?"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_REGEX = r"(?:(?<=[=(,:!&|?;\[{}])|(?<=return))[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*"
_PY_LONG = r"(?i:\b[rbfu]{1,2})?(?:'''[\s\S]*?(?:'''|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z))"
#: What is blanked: comments, strings and the like.
HIDDEN = {
    "csharp": "|".join([_COMMENT, r'\$?"""[\s\S]*?(?:"""|\Z)', r'(?:@\$?|\$@)"(?:[^"]|"")*(?:"|\Z)', r"\$?" + _STRING, _CHAR, r"(?m:^[ \t]*#[^\n]*)"]),
    "java": "|".join([_COMMENT, r'"""[\s\S]*?(?:"""|\Z)', _STRING, _CHAR]),
    "javascript": "|".join([_COMMENT, r"`(?:\\[\s\S]|[^`\\])*(?:`|\Z)", _STRING, _QUOTED, _REGEX]),
    "go": "|".join([_COMMENT, r"`[^`]*(?:`|\Z)", _STRING, _CHAR]),
    "python": "|".join([_PY_LONG, r"\#[^\n]*", _STRING, _QUOTED]),
}
HIDDEN["typescript"] = HIDDEN["javascript"]
HIDDEN = {k: re.compile(v) for k, v in HIDDEN.items()}

_WORDS = (r"(?:public|private|protected|internal|static|abstract|sealed|partial|final|readonly|ref|unsafe|extern|new|virtual|override|async|export|default|declare|"
          r"strictfp|synchronized|native|transient|volatile|non-sealed|required|file|get|set|const)")
_MODS = re.compile(rf"(?:{_WORDS}\s+)*")
_TYPE = re.compile(r"(class|interface|struct|enum|record(?:\s+(?:class|struct))?|@interface)\s+([\w$]+)\s*(.*)", re.S)
_NAME = re.compile(r"(?:(?P<rtype>[\w$.<>\[\],?:\s()*&]+?)[\s\]>?)]\s*)?(?P<name>~?[\w$.]+|operator\s*\S+)\s*(?:<[^()]*>)?\s*$", re.S)
_JS_HEAD = re.compile(r"(?:^|[\n;}]|(?<=\s))(?P<mods>(?:(?:export|default|async|static|public|private|protected|abstract|override|readonly|get|set)\s+)*)"
                      r"(?P<word>function\s*\*?\s*)?(?P<name>\*?[\w$#]+)\s*(?:<[^>()]*>)?\s*\(")
_JS_ARROW = re.compile(r"(?P<mods>(?:export\s+)?)(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)|(?P<one>[\w$]+))\s*(?::[^=]+)?=>\s*$")
_JS_TYPE = re.compile(r"(?:^|[\n;}]|(?<=\s))(?P<mods>(?:(?:export|default|abstract|declare|const)\s+)*)(?P<kind>class|interface|enum)\s+(?P<name>[\w$]+)(?P<rest>[^;{}=]*)$")
_GO_TYPE = re.compile(r"(?m)^[ \t]*(type\s+)?(\w+)(?:\[[^\]]*\])?[ \t]+(struct|interface)\s*\Z")
_GO_GROUP = re.compile(r"(?m)^type\s*\(")
_GO_FUNC = re.compile(r"(?m)^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*\(")
_PY_HEAD = re.compile(r"((?:async\s+)?)(class|def)\s+(\w+)\s*(?:\[[^\]]*\])?\s*(.*)", re.S)
_KEYWORDS = frozenset("if for foreach while switch catch using lock fixed return new else do try synchronized function with super this throw when await typeof nameof sizeof default".split())
#: Characters that a head in C# or Java has at most; a longer run of text without a border is no declaration.
LONGEST = 8192
_MARK = re.compile(r"[{}()\[\];]")
_BLANK = re.compile(r"\s+")


def hide(text: str, language: str) -> str:
    """``text`` with strings and comments blanked; line ends and lengths stay."""
    return HIDDEN[language].sub(lambda m: "".join(c if c == "\n" else " " for c in m.group()), text)


def _flat(text: str) -> str:
    return _BLANK.sub(" ", text).strip()


def _close(text: str, at: int) -> int:
    """Where the bracket at ``at`` closes, or -1."""
    depth = 0
    for m in re.compile(r"[()\[\]]").finditer(text, at):
        depth += 1 if m.group() in "([" else -1
        if not depth:
            return m.start()
    return -1


def _after_marks(head: str) -> int:
    """Where the head begins after attributes and annotations."""
    at = 0
    while True:
        at += len(head[at:]) - len(head[at:].lstrip())
        if head.startswith("[", at):
            end = _close(head, at)
        elif (m := re.compile(r"@(?!interface\b)[\w.]+\s*").match(head, at)):
            end = m.end() - 1
            if head.startswith("(", m.end()):
                end = _close(head, m.end())
        else:
            return at
        if end < 0:
            return at
        at = end + 1


def _bases(language: str, rest: str) -> str:
    rest = _flat(rest)
    if rest.startswith("<"):
        depth, i = 0, 0
        for i, c in enumerate(rest):
            depth += (c == "<") - (c == ">")
            if not depth:
                break
        rest = rest[i + 1:].strip()
    if rest.startswith("("):
        rest = rest[_close(rest, 0) + 1:].strip() if _close(rest, 0) >= 0 else ""
    if language == "csharp":
        return re.split(r"\bwhere\b", rest[1:])[0].strip() if rest.startswith(":") else ""
    found = re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\s+(?:extends|implements|permits)\b|$)", rest)
    return ", ".join(x.strip() for x in found)


def _java_like(language: str, head: str, parent: dict | None, body: bool) -> dict | None:
    """The declaration that ``head`` makes in C# or Java, if it makes one."""
    skip = _after_marks(head)
    mods = _MODS.match(head, skip).group()
    rest = head[skip + len(mods):]
    found = {"skip": skip, "mods": _flat(mods), "rtype": "", "params": "", "bases": ""}
    if (m := _TYPE.match(rest)) and (body or m.group(1).startswith("record")):
        kind = "record" if m.group(1).startswith("record") else "interface" if m.group(1) == "@interface" else m.group(1)
        return found | {"kind": kind, "name": m.group(2), "bases": _bases(language, m.group(3))}
    if parent is None or not parent["type"] or len(rest) > LONGEST or re.match(r"(?:delegate|event|implicit|explicit|case)\b", rest):
        return None
    first = rest.find("(")
    arrow = rest.find("=>")
    equals = re.search(r"(?<![=!<>])=(?![=>])", rest)
    if first >= 0 and not (equals and equals.start() < first) and not (0 <= arrow < first):
        if not rest[:first].strip():  # a tuple is returned
            end = _close(rest, first)
            first = rest.find("(", end + 1) if end >= 0 else -1
        end = _close(rest, first) if first >= 0 else -1
        m = _NAME.match(rest[:first]) if end >= 0 else None
        if m is None or m["name"].split(".")[-1] in _KEYWORDS:
            return None
        tail = rest[end + 1:].strip()
        if tail and not re.match(r"=>|:|where\b|throws\b|default\b", tail):
            return None
        name, rtype = m["name"].split(".")[-1], _flat(rest[:m.start("name")])
        rtype = re.sub(r"^<[^()]*?>\s+", "", rtype)  # type parameters of a Java method
        found |= {"name": name, "rtype": rtype, "params": _flat(rest[first + 1:end])}
        if not rtype:
            return found | {"kind": "constructor"} if name.lstrip("~") == parent["name"] else None
        return found | {"kind": "method"}
    if language == "csharp" and (body or arrow >= 0):
        head_only = rest[:arrow] if arrow >= 0 else rest
        if equals and (arrow < 0 or equals.start() < arrow):
            return None
        m = re.match(r"(?P<rtype>.+?)\s+(?P<name>[\w.]+)\s*(?:\[[^\]]*\])?\s*$", head_only, re.S)
        if m and m["name"] not in _KEYWORDS:
            return found | {"kind": "property", "name": m["name"].split(".")[-1], "rtype": _flat(m["rtype"])}
    return None


def _script(language: str, head: str, parent: dict | None, body: bool) -> dict | None:
    """The same for JavaScript and TypeScript, whose statements may end without a sign."""
    if not body:
        return None
    if m := _JS_TYPE.search(head):
        return {"skip": m.start("mods"), "kind": m["kind"], "mods": _flat(m["mods"]), "name": m["name"], "rtype": "", "params": "", "bases": _bases(language, m["rest"])}
    if m := _JS_ARROW.search(head):
        return {"skip": m.start(), "kind": "method", "mods": _flat(m["mods"] + ("async" if re.search(r"=\s*async\b", m.group()) else "")), "name": m["name"], "rtype": "",
                "params": _flat(m["params"] or m["one"] or ""), "bases": ""}
    for m in reversed(list(_JS_HEAD.finditer(head))):
        end = _close(head, m.end() - 1)
        if end < 0 or not re.match(r"\s*(?::[^;=]*)?$", head[end + 1:]):
            continue
        name = m["name"].lstrip("*")
        if name in _KEYWORDS or not (m["word"] or (parent and parent["type"])):
            return None
        begin = m.start("mods") if m["mods"] else m.start("word") if m["word"] else m.start("name")
        return {"skip": begin, "kind": "constructor" if name == "constructor" else "method", "mods": _flat(m["mods"]), "name": name,
                "rtype": _flat(head[end + 1:]).lstrip(": "), "params": _flat(head[m.end():end]), "bases": ""}
    return None


def _go(language: str, head: str, parent: dict | None, body: bool) -> dict | None:
    if not body:
        return None
    found = {"mods": "", "rtype": "", "params": "", "bases": ""}
    m = _GO_TYPE.search(head)
    if m and (m.group(1) or _GO_GROUP.search(head)):  # a type inside ``type ( ... )`` goes without the word
        return found | {"skip": m.end() - len(m.group().lstrip()), "kind": m.group(3), "name": m.group(2)}
    for m in _GO_FUNC.finditer(head):
        end = _close(head, m.end() - 1)
        if end >= 0 and "\nfunc" not in head[end:]:
            return found | {"skip": m.start(), "kind": "method", "name": m.group(2), "params": _flat(head[m.end():end]), "rtype": _flat(head[end + 1:]), "receiver": m.group(1)}
    return None


_HEADS = {"csharp": _java_like, "java": _java_like, "javascript": _script, "typescript": _script, "go": _go}
_TYPES = {"class", "interface", "struct", "record", "enum"}


def _braces(text: str, language: str) -> list[dict]:
    classify, out, stack = _HEADS[language], [], []
    starts = [0]
    starts += [m.end() for m in re.finditer("\n", text)]

    def line(at: int) -> int:
        lo, hi = 0, len(starts)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if starts[mid] <= at else (lo, mid)
        return lo

    def declare(head_at: int, end: int, body: bool) -> dict | None:
        head = text[head_at:end]
        if not head.strip():
            return None
        parent = stack[-1]["mark"] if stack else None
        mark = classify(language, head, parent, body)
        if mark:
            types = [b["mark"]["name"] for b in stack if b["mark"] and b["mark"]["type"]]
            begin = mark["skip"] + len(head[mark["skip"]:]) - len(head[mark["skip"]:].lstrip())
            mark |= {"type": mark["kind"] in _TYPES, "owner": mark.pop("receiver", None) or ".".join(types) or None, "line": line(head_at + begin), "end_line": line(end)}
            out.append(mark)
        return mark

    depth = head = 0
    for m in _MARK.finditer(text):
        c, at = m.group(), m.start()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == ";":
            if not depth:
                declare(head, at, False)
                head = at + 1
        elif c == "{":
            grouped = language == "go" and depth == 1 and not stack
            stack.append({"mark": None if depth and not grouped else declare(head, at, True), "depth": depth, "head": head})
            depth, head = 0, at + 1
        elif stack:
            block = stack.pop()
            if block["mark"]:
                block["mark"]["end_line"] = line(at)
            depth = block["depth"]
            head = block["head"] if depth else at + 1
        else:
            depth, head = 0, at + 1
    for block in stack:  # never closed: to the end of the file
        if block["mark"]:
            block["mark"]["end_line"] = len(starts)
    return out


def _indents(text: str) -> list[dict]:
    """Python: logical lines by brackets, blocks by indents."""
    out, stack, number, last = [], [], 0, 0
    lines = text.split("\n")
    while number < len(lines):
        first, whole = number, lines[number]
        open_ = sum(map(whole.count, "([{")) - sum(map(whole.count, ")]}"))
        while (open_ > 0 or whole.endswith("\\")) and number + 1 < len(lines):
            number += 1
            open_ += sum(map(lines[number].count, "([{")) - sum(map(lines[number].count, ")]}"))
            whole += "\n" + lines[number]
        number += 1
        if not whole.strip():
            continue
        indent = len(whole.expandtabs(8)) - len(whole.expandtabs(8).lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()[1]["end_line"] = last
        last = number
        if m := _PY_HEAD.match(whole.strip()):
            rest = m.group(4)
            end = _close(rest, 0) if rest.startswith("(") else -1
            inner, tail = (_flat(rest[1:end]), rest[end + 1:]) if end >= 0 else ("", rest)
            if not re.match(r"\s*(?:->.*)?:", tail, re.S) or (m.group(2) == "def" and end < 0):
                continue
            names = [s[1]["name"] for s in stack if s[1]["kind"] == "class"]
            kind = "class" if m.group(2) == "class" else "method"
            rtype = re.match(r"\s*->\s*(.*?)\s*:", tail, re.S)
            mark = {"kind": kind, "name": m.group(3), "owner": ".".join(names) or None, "line": first + 1, "end_line": number, "mods": m.group(1).strip(),
                    "rtype": _flat(rtype.group(1)) if rtype and kind == "method" else "", "params": inner if kind == "method" else "", "bases": inner if kind == "class" else ""}
            out.append(mark)
            stack.append((indent, mark))
    while stack:
        stack.pop()[1]["end_line"] = last
    return out


def scan(text: str, language: str) -> list[dict]:
    """Declarations of one text in order; an unknown language has none."""
    if language not in HIDDEN or not text:
        return []
    plain = hide(text.replace("\r\n", "\n"), language)
    return _indents(plain) if language == "python" else _braces(plain, language)


_FIELDS = ["kind", "name", "owner", "line", "end_line", "mods", "rtype", "params", "bases"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()] * 4
    for b in batches:
        rows = [(name, language, *[d[f] for f in _FIELDS]) for name, language, text in zip(*[(x.as_py() for x in b.column(i)) for i in range(3)]) for d in scan(text, language)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["file_name", "language", *_FIELDS])


def block_symbols(files: DataFrame) -> DataFrame:
    """One row per declaration of ``files`` (file_name, language, content), with owner and extent by blocks.

    ``owner`` is the path of the types around it, for Go the receiver. ``line`` is where the head begins after its
    attributes, ``end_line`` where the block closes. Null and empty texts, and languages without a scanner, have
    no rows. No shuffle: a file is scanned where it is read.
    """
    return files.select("file_name", "language", "content").mapInArrow(_scan, SYMBOLS)
