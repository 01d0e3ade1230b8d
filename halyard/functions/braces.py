"""Outlines of languages with braces or `end` blocks, by a shared scanner: strings and comments are blanked, then each
statement head is read by its language's rules, knowing which kind of block it stands in.

What the scanner can't balance raises PARSE_ERROR.
"""

from __future__ import annotations

import bisect
import re

from halyard.functions.outlines import OutlineError, Symbol

NEWLINE = {"go", "kotlin", "swift", "scala", "javascript", "typescript"}
HASH = {"php"}
NOT_NAMES = frozenset("catch do else for foreach function if lock new return sizeof switch throw using when while with synchronized assert".split())

_BLANK = {
    "quote": r"\"(?:[^\"\\\n]|\\.)*\"", "tick": r"'(?:[^'\\\n]|\\.)*'", "template": r"`(?:[^`\\]|\\.)*`", "line": r"//[^\n]*", "block": r"/\*.*?\*/", "hash": r"#(?!\[)[^\n]*",
    "triple": r'"""(?:.|\n)*?"""', "raw": r"`[^`]*`", "char": r"'(?:[^'\\\n]|\\.[^']*)'", "macro": r"(?m:^[ \t]*#(?:[^\n\\]|\\.|\\\n)*)", "zigtext": r"\\\\[^\n]*",
}


def _kinds(lang: str) -> list[str]:
    if lang in ("javascript", "typescript"):
        return ["line", "block", "template", "quote", "tick"]
    if lang == "go":
        return ["line", "block", "raw", "quote", "char"]
    if lang in ("c", "cpp"):
        return ["line", "block", "macro", "quote", "char"]
    if lang == "php":
        return ["line", "block", "hash", "quote", "tick"]
    if lang == "zig":
        return ["line", "zigtext", "quote", "char"]
    return ["line", "block", "triple", "quote", "char" if lang in ("rust", "scala", "java", "csharp", "kotlin") else "tick"]


def masked(text: str, lang: str) -> str:
    """The text with comments as spaces and literals as their quotes around spaces, line feeds kept."""
    def blank(m: re.Match) -> str:
        gone = re.sub(r"[^\n]", " ", m[0])
        return gone if m[0][0] in "/#\\ \t" or len(gone) < 2 else m[0][0] + gone[1:-1] + m[0][-1]

    return re.sub("|".join(_BLANK[k] for k in _kinds(lang)), blank, text, flags=re.S)


def _matches(code: str) -> dict[int, int]:
    """The closing place of each opening brace; raises where brackets don't balance."""
    stack, out = [], {}
    for m in re.finditer(r"[{}()\[\]]", code):
        c = m[0]
        if c in "{([":
            stack.append((c, m.start()))
        else:
            if not stack or stack[-1][0] != {"}": "{", ")": "(", "]": "["}[c]:
                raise OutlineError("PARSE_ERROR", f"bracket at {m.start()}")
            out[stack.pop()[1]] = m.start()
    if stack:
        raise OutlineError("PARSE_ERROR", f"bracket at {stack[-1][1]}")
    return out


_CLASSY = re.compile(r"\b(class|interface|trait|struct|enum(?:\s+class)?|record|contract|library|protocol|object)\s+(?:[A-Z][A-Z0-9_]*\s+(?=[A-Za-z_]))?([A-Za-z_$][\w$]*)")
_KIND = {"protocol": "interface", "object": "class", "library": "contract"}
_HEADS = {
    "javascript": "class", "typescript": "class interface enum", "java": "class interface enum record", "csharp": "class interface enum record struct", "kotlin": "class interface enum object", "swift": "class struct enum protocol",
    "rust": "struct enum trait", "php": "class interface trait enum", "scala": "trait class object enum", "c": "struct enum", "cpp": "class struct enum", "solidity": "contract interface struct enum library",
}
_CALL = re.compile(r"([~#A-Za-z_$][\w$]*)\s*(?:<[^<>]*>)?\s*\(")


def _read(lang: str, head: str, end: str, cls: str | None, place: str) -> tuple[list[tuple[str, str, str]], str | None, str]:
    """What a statement head declares: [(name, kind, from this word on)], the class its block belongs to, the block's kind.

    place: the kind of block the head is in: class, code or file. end: the character that ended the head.
    """
    js, body = lang in ("javascript", "typescript"), end == "{"
    inside = "method" if cls else "function"
    if lang == "go":
        if m := re.match(r"\s*type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)?", head):
            kind = m[2] or "type"
            return [(m[1], kind, "type")], m[1] if m[2] else cls, "class" if m[2] else "code"
        if m := re.match(r"\s*func\s+(\([^)]*\)\s*)?(\w+)", head):
            return ([(m[2], "method" if m[1] else "function", "func")] if body else []), cls, "code"
        return [], cls, "code"
    if lang == "zig":
        if body and (m := re.search(r"\bconst\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?(struct|enum)\b", head)):
            return [(m[1], m[2], m[0].split()[0])], m[1] if m[2] == "struct" else cls, "class"
        if m := re.search(r"\bfn\s+(\w+)\s*\(", head):
            return ([(m[1], inside, "fn")] if body else []), cls, "code"
        return [], cls, "code"
    if lang == "rust":
        if m := re.match(r"\s*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>)?\s*(?:[\w:<>, '&]+?\s+for\s+)?(?:&\s*)?([\w:]+)", head):
            return [], m[1], "class"
        if m := re.search(r"\bfn\s+(\w+)", head):
            return ([(m[1], inside, "fn")] if body else []), cls, "code"
        if m := re.match(r"\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", head):
            return [(m[1], "type", "type")], cls, "code"
    if js:
        if m := re.match(r"\s*(?:export\s+)?(?:declare\s+)?type\s+([\w$]+)\s*(?:<[^=]*>)?\s*=", head):
            return ([(m[1], "type", "type")] if lang == "typescript" else []), cls, "code"
        if m := re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*[<(]", head):
            return ([(m[1], inside, "function")] if body else []), cls, "code"
        if m := re.search(r"(?:^|\s)(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^=]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", head):
            return [(m[1], inside, m[1])], cls, "code"
    words = _HEADS.get(lang, "").split()
    for m in _CLASSY.finditer(head):
        word = m[1].split()[0]
        if word not in words or "(" in head[: m.start()] or re.search(r"[=.]\s*$", head[: m.start()]) or (lang == "java" and word == "record" and "(" not in head):
            continue
        name, kind = m[2], _KIND.get(word, word)
        if lang in ("c", "cpp") and (not body or "(" in head or "=" in head):
            if word != "enum" or not body:
                break
        if lang == "kotlin" and re.search(r"\benum\s+class\b", head):
            kind = "enum"
        holds = kind != "enum"
        return [(name, kind, word)], name if holds else cls, "class"
    if re.search(r"\b(namespace|extern|package|mod|extension)\b", head) and body and "(" not in head:
        return [], cls, "file"
    if lang in ("kotlin", "swift", "scala", "php"):
        if lang == "swift" and place == "class" and re.search(r"(?:^|\s)init[?!]?\s*[<(]", head):
            return [("init", "constructor", "init")], cls, "code"
        if m := re.search(r"\b(?:fun|func|def|function)\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?&?(\w+)", head):
            word = re.search(r"\b(fun|func|def|function)\b", head)[1]
            return [(m[1], inside, word)], cls, "code"
        if lang in ("kotlin", "swift") and (m := re.search(r"(?:^|\s)(val|var|let)\s+(\w+)", head)) and "(" not in head[: m.start()]:
            return [(m[2], "property", m[1])], cls, "code"
        return [], cls, "code"
    if lang == "solidity":
        if place == "class" and re.match(r"\s*constructor\b", head):
            return [("constructor", "constructor", "constructor")], cls, "code"
        if m := re.match(r"\s*(function|modifier)\s+(\w+)", head):
            return [(m[2], "method" if m[1] == "modifier" else inside, m[1])], cls, "code"
        return [], cls, "code"
    call = _CALL.search(re.sub(r"@\w+(?:\([^)]*\))?", lambda a: " " * len(a[0]), head))
    if call and call[1] not in NOT_NAMES and "=" not in head[: call.start()]:
        before = head[: call.start()].strip()
        if js:
            if place == "class" and body and re.fullmatch(r"(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract|\*)\s*)*", before):
                return [(call[1], "method", call[1])], cls, "code"
        elif lang in ("java", "csharp"):
            if place == "class":
                if call[1] == cls and not re.search(r"[\w>\]]\s*$", re.sub(r"\b(public|private|protected|internal|static)\b", "", before)):
                    return [(call[1], "constructor", "")], cls, "code"
                if re.search(r"[\w>\]?]$", before) and before.split()[-1] not in NOT_NAMES:
                    return [(call[1], "method", "")], cls, "code"
        elif lang in ("c", "cpp"):
            name = call[1]
            member = re.search(r"(\w+)\s*::\s*$", head[: call.start()])
            typed = bool(re.search(r"[\w*&>]\s*$", before)) and before.split()[-1] not in NOT_NAMES
            if body and place != "code" and (typed or name == cls or member or name.startswith("~")):
                return [(name, "method" if cls else "function", "")], cls, "code"
            if end == ";" and place != "code" and (typed or name == cls):
                return [(name, "constructor" if name == cls else "method", "")], cls, "code"
    if lang == "csharp" and place == "class" and body and (m := re.search(r"[\w>\]?]\s+(\w+)\s*$", head)) and "(" not in head and not re.search(r"\b(get|set|add|remove)\s*$", head):
        return [(m[1], "property", "")], cls, "code"
    return [], cls, "code"


def braces(text: str, lang: str) -> list[Symbol]:
    code = masked(text, lang)
    if lang == "php" and "<?php" in code:
        code = code.replace("<?php", "     ")
    if lang == "cpp":
        code = re.sub(r"\b(public|private|protected)\s*:(?!:)", lambda m: " " * (len(m[0]) - 1) + ";", code)
    pair = _matches(code)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def place_of(at: int) -> tuple[int, int]:
        k = bisect.bisect_right(starts, at) - 1
        return k + 1, len(text[starts[k] : at].encode("utf-8", "surrogatepass"))

    out: list[Symbol] = []
    stack: list[tuple[str | None, str]] = [(None, "file")]
    begin, depth = 0, 0
    for m in re.finditer(r"[{};()\[\]\n]", code):
        c, at = m[0], m.start()
        if c in "([":
            depth += 1
            continue
        if c in ")]":
            depth -= 1
            continue
        if c == "\n" and (lang not in NEWLINE or depth):
            continue
        if depth and c in "{};" and not (c == "{" or c == "}"):
            continue
        head = code[begin:at]
        if c == "\n" and (not head.strip() or re.match(r"\s*[{.]", code[at:]) or re.search(r"[,=(|&+]\s*$|=>\s*$", head)):
            continue
        cls, where = stack[-1]
        if c != "}" or head.strip():
            found, owner, block = _read(lang, head, "{" if c == "{" else ";", cls, where) if head.strip() else ([], cls, "code")
            if where == "code" and block == "file":
                block = "code"
            for name, kind, word in found:
                lead = len(head) - len(head.lstrip())
                start = begin + (m2.start() if word and (m2 := re.search(rf"(?<![\w$]){re.escape(word)}(?![\w$])", head)) else lead)
                end = pair[at] + 1 if c == "{" else at + (c == ";")
                out.append(Symbol(name, kind, *place_of(start), *place_of(end)))
            if c == "{":
                stack.append((owner, block))
        elif c == "{":
            stack.append((cls, "code"))
        if c == "}":
            if len(stack) > 1:
                stack.pop()
        begin = at + 1
    if code[begin:].strip() and lang in NEWLINE:
        found, _, _ = _read(lang, code[begin:], ";", *stack[-1])
        out += [Symbol(n, k, *place_of(begin + len(code[begin:]) - len(code[begin:].lstrip())), *place_of(len(code.rstrip()))) for n, k, _ in found]
    return out


_ENDS = {
    "ruby": (r"^\s*(?:(?:private|public|protected)\s+)?(class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\s*(?:\|[^|]*\|)?\s*$", r"^\s*end\b"),
    "elixir": (r"\bdo\s*$|\bfn\b(?!.*\bend\b)", r"^\s*end\b"),
    "lua": (r"\bfunction\b|\bthen\s*$|\bdo\s*$|^\s*repeat\b", r"\bend\b|^\s*until\b"),
}


def ends(text: str, lang: str) -> list[Symbol]:
    """Ruby, Elixir and Lua: blocks that `end` closes."""
    comment = {"ruby": r"#.*", "elixir": r"#.*", "lua": r"--.*"}[lang]
    lines = text.split("\n")
    opens, shuts = (re.compile(p) for p in _ENDS[lang])
    out: list[Symbol] = []
    stack: list[tuple[int | None, str | None]] = []
    cls: str | None = None
    for i, raw in enumerate(lines):
        line = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", '""', raw.rstrip("\r"))
        line = re.sub(comment, "", line)
        found = None
        if lang == "ruby":
            if m := re.match(r"\s*(?:class|module)\s+([A-Z][\w:]*)", line):
                found = (m[1], "class", m[1])
            elif m := re.match(r"\s*(?:(?:private|public|protected)\s+)?def\s+(?:self\.)?([\w?!=+\-*/<>\[\]]+)", line):
                found = (m[1], "method", cls)
        elif lang == "elixir":
            if m := re.match(r"\s*defmodule\s+([\w.]+)", line):
                found = (m[1], "class", m[1])
            elif m := re.match(r"\s*defprotocol\s+([\w.]+)", line):
                found = (m[1], "interface", m[1])
            elif m := re.match(r"\s*def(?:p|macro|macrop)?\s+([\w?!]+)", line):
                found = (m[1], "method" if cls else "function", cls)
        elif m := re.match(r"\s*(?:local\s+)?function\s+([\w.:]+)", line):
            found = (m[1], "function", cls)
        column = len(raw) - len(raw.lstrip())
        index = None
        if found:
            index = len(out)
            out.append(Symbol(found[0], found[1], i + 1, column, i + 1, len(raw.rstrip().encode())))
        n_open, n_shut = len(opens.findall(line)), len(shuts.findall(line))
        if lang == "ruby" and re.match(r"\s*(while|until|for)\b.*\bdo\s*$", line):
            n_open = 1
        for _ in range(n_open):
            stack.append((index, cls))
            if found:
                cls = found[2]
            index = None
        for _ in range(n_shut):
            if not stack:
                raise OutlineError("PARSE_ERROR", f"line {i + 1}")
            k, cls = stack.pop()
            if k is not None:
                s = out[k]
                out[k] = Symbol(s.name, s.kind, s.start, s.column, i + 1, len(raw.rstrip().encode()))
    if stack:
        raise OutlineError("PARSE_ERROR", "a block isn't closed")
    return out
