"""Outlines of single files: one row per symbol (name, kind, start and end line and column).

Lines count from 1, columns from 0, ends are exclusive. Columns are UTF-16 units in Markdown and UTF-8 bytes elsewhere.
A file that doesn't parse raises OutlineError("PARSE_ERROR"): nothing is guessed.
"""

from __future__ import annotations

import ast
import json
import re
from collections import Counter
from dataclasses import dataclass

MAX_ITEMS, MAX_CHILDREN = 500, 50

LANGUAGES = {
    "bash": "bash sh", "c": "c h", "cpp": "cc cpp cxx hpp", "csharp": "cs", "elixir": "ex exs", "go": "go", "java": "java", "javascript": "cjs js jsx mjs", "json": "json", "kotlin": "kt kts",
    "lua": "lua", "markdown": "markdown md mdx", "php": "php", "python": "py pyi", "ruby": "rb", "rust": "rs", "scala": "scala", "solidity": "sol", "swift": "swift", "toml": "toml",
    "typescript": "cts mts ts tsx", "yaml": "yaml yml", "zig": "zig",
}
BY_EXTENSION = {e: name for name, exts in LANGUAGES.items() for e in exts.split()}


class OutlineError(ValueError):
    """An outline that isn't given; the code comes first."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    start: int
    column: int
    end: int
    end_column: int


def language_of(path: str, asked: str | None = None) -> str:
    got = BY_EXTENSION.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower())
    if got is None:
        raise OutlineError("UNSUPPORTED_LANGUAGE", path)
    if asked is not None and asked != got:
        raise OutlineError("LANGUAGE_EXTENSION_MISMATCH", f"{path} is {got}, not {asked}")
    return got


def _utf16(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


# --- Markdown ---------------------------------------------------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _cells(row: str) -> list[str]:
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", row)]


def markdown(text: str) -> list[Symbol]:
    """Sections down to the next heading of their level or above, tables and their rows, fenced blocks; by line."""
    lines = re.split(r"\r?\n", text)
    width = lambda n: _utf16(lines[n - 1]) if 0 < n <= len(lines) else 0
    heads: list[tuple[int, int, str]] = []
    found: list[Symbol] = []
    rows: list[tuple[int, str]] = []
    i, before = 0, ""  # before: the paragraph line that an underline would make a heading
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            close = re.compile(r" {0,3}" + re.escape(m[1][0]) + "{" + str(len(m[1])) + r",}[ \t]*$")
            j = i + 1
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            end = min(j + 1, len(lines))
            found.append(Symbol(f"fence:L{i + 1}", "code_block", i + 1, 0, end, width(end)))
            i, before = j + 1, ""
            continue
        if m := _ATX.match(line):
            heads.append((i + 1, len(m[1]), (m[2] or "").strip()))
            i, before = i + 1, ""
            continue
        if before and re.match(r" {0,3}(=+|-+)[ \t]*$", line):
            heads.append((i, 1 if line.strip()[0] == "=" else 2, before.strip()))
            i, before = i + 1, ""
            continue
        if "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _RULE.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])) and not line.startswith("    "):
            j = i + 2
            while j < len(lines) and lines[j].strip() and not _FENCE.match(lines[j]) and not _ATX.match(lines[j]):
                rows.append((j + 1, re.sub(r"\s+", " ", _cells(lines[j])[0].replace("`", "")).strip()))
                j += 1
            found.append(Symbol(f"Table (L{i + 1}-L{j})", "table", i + 1, 0, j, width(j)))
            i, before = j, ""
            continue
        before = line if line.strip() and not re.match(r"\s{4}|\s*([-*+>]|\d+[.)])\s", line) else ""
        i += 1
    out = []
    for k, (line, level, title) in enumerate(heads):
        end = next((max(line, n - 1) for n, lv, _ in heads[k + 1 :] if lv <= level), len(lines))
        out.append(Symbol(f"{'#' * level} {title}", "section", line, 0, end, width(end)))
    seen = Counter(t for _, t in rows if t)
    for n, t in rows:
        name = f"row:L{n}" if not t else f"row:{t} (L{n})" if seen[t] > 1 or re.search(r"^L\d+$|\(L\d+\)$", t) else f"row:{t}"
        found.append(Symbol(name, "table_row", n, 0, n, width(n)))
    return sorted(out + found, key=lambda s: s.start)


# --- JSON -------------------------------------------------------------------------------------------------------------

_SPACE = re.compile(r"[ \t\r\n]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


@dataclass
class _Node:
    kind: str
    start: int
    end: int
    children: list  # of nodes, or of (key, start, end, node)
    value: str = ""


def _json(text: str) -> _Node:
    """A tree with places; explicit stack, so depth is no limit."""

    def fail(at: int):
        raise OutlineError("PARSE_ERROR", f"JSON at {at}")

    def skip(at: int) -> int:
        return _SPACE.match(text, at).end()

    root: list[_Node] = []
    stack: list[_Node] = []
    at, key = skip(0), None
    want = "value"
    while True:
        c = text[at : at + 1]
        if want == "value":
            node = None
            if c in ("{", "["):
                node = _Node("object" if c == "{" else "array", at, at, [])
                new = at + 1
            elif m := _STRING.match(text, at):
                node, new = _Node("string", at, m.end(), [], json.loads(m[0])), m.end()
            elif m := _SCALAR.match(text, at):
                node, new = _Node("scalar", at, m.end(), []), m.end()
            else:
                fail(at)
            if not stack:
                root.append(node)
            elif stack[-1].kind == "object":
                stack[-1].children.append((key[0], key[1], node))
            else:
                stack[-1].children.append(node)
            at = skip(new)
            if c in ("{", "["):
                stack.append(node)
                closing = "}" if c == "{" else "]"
                want = "close" if text[at : at + 1] == closing else "key" if c == "{" else "value"
            else:
                want = "next"
        elif want == "key":
            m = _STRING.match(text, at) or fail(at)
            key = (json.loads(m[0]), at)
            at = skip(m.end())
            if text[at : at + 1] != ":":
                fail(at)
            at, want = skip(at + 1), "value"
        elif want == "close":
            stack.pop().end = at + 1
            at, want = skip(at + 1), "next"
        elif not stack:
            if at != len(text):
                fail(at)
            return root[0]
        elif c == ",":
            at, want = skip(at + 1), "key" if stack[-1].kind == "object" else "value"
        elif c == ("}" if stack[-1].kind == "object" else "]"):
            want = "close"
        else:
            fail(at)


class _Places:
    """Line and UTF-8 column of character offsets."""

    def __init__(self, text: str) -> None:
        self.text, self.starts = text, [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, at: int) -> tuple[int, int]:
        import bisect

        k = bisect.bisect_right(self.starts, at) - 1
        return k + 1, len(self.text[self.starts[k] : at].encode("utf-8", "surrogatepass"))


def json_outline(text: str) -> list[Symbol]:
    """Keys of two levels, and the objects in their arrays by id, by index, or by both where ids aren't sure."""
    root, place, out, names = _json(text), _Places(text), [], set()
    escape = lambda k: re.sub(r"[\\.\[\]]", r"\\\g<0>", k)

    def add(name: str, kind: str, start: int, end: int) -> None:
        if name in names:
            raise OutlineError("AMBIGUOUS_SYMBOL_IDENTITY", name)
        names.add(name)
        out.append(Symbol(name, kind, *place(start), *place(end)))

    def items(node: _Node, prefix: str) -> None:
        if not any(c.kind == "object" for c in node.children):
            return
        if len(node.children) > MAX_ITEMS:
            raise OutlineError("OUTLINE_LIMIT_EXCEEDED", prefix)
        got = []
        for k, c in enumerate(node.children):
            if c.kind == "object":
                ids = [(key, v) for key, _, v in c.children if key in ("id", "name", "key") or (key.endswith("_id") and len(key) > 3)]
                values = [v.value.strip() if v.kind == "string" else "" for _, v in ids]
                distinct = list(dict.fromkeys(v for v in values if v))
                unsure = len({key for key, _ in ids}) < len(ids) or "" in values or len(distinct) > 1
                got.append((k, c, distinct, unsure))
        uses = Counter(v for _, _, d, _ in got for v in d)
        for k, c, distinct, unsure in got:
            if not distinct:
                name = f"{prefix}[{k}]"
            elif unsure or uses[distinct[0]] > 1 or re.search(r"^\d+$|#\d+$", distinct[0]):
                name = f"{prefix}[{distinct[0]}#{k}]"
            else:
                name = f"{prefix}[{distinct[0]}]"
            add(name, "config_item", c.start, c.end)

    if root.kind == "array":
        items(root, "")
    for key, at, v in root.children if root.kind == "object" else []:
        name = escape(key)
        add(name, "config_block", at, v.end)
        if v.kind == "object" and len(v.children) <= MAX_CHILDREN:
            for k2, at2, v2 in v.children:
                add(f"{name}.{escape(k2)}", "config_block", at2, v2.end)
                if v2.kind == "array":
                    items(v2, f"{name}.{escape(k2)}")
        elif v.kind == "array":
            items(v, name)
    return out


# --- TOML, YAML, Bash -------------------------------------------------------------------------------------------------


def _bare(key: str) -> str:
    key = key.strip()
    if len(key) > 1 and key[0] == key[-1] == '"':
        try:
            return json.loads(key)
        except ValueError:
            return key[1:-1]
    return key[1:-1] if len(key) > 1 and key[0] == key[-1] == "'" else key


def toml(text: str) -> list[Symbol]:
    """Tables, arrays of tables, their pairs, and pairs before the first table."""
    import tomllib

    try:
        tomllib.loads(text.replace("\r\n", "\n"))
    except tomllib.TOMLDecodeError as e:
        raise OutlineError("PARSE_ERROR", str(e)) from None
    lines = re.split(r"\r?\n", text)
    out: list[Symbol] = []
    table, head, i = None, None, 0

    def close(last: int) -> None:
        if head is not None:
            while last > head[2] and (not lines[last - 1].strip() or lines[last - 1].lstrip().startswith("#")):
                last -= 1
            out[head[0]] = Symbol(*head[1], head[2], 0, last, len(lines[last - 1].encode()))

    while i < len(lines):
        line = lines[i]
        if m := re.match(r"\s*\[\[(.+?)\]\]\s*(?:#.*)?$", line) or re.match(r"\s*\[(.+?)\]\s*(?:#.*)?$", line):
            close(i)
            double = line.lstrip().startswith("[[")
            table = _bare(m[1])
            head = (len(out), (f"[[{table}]]" if double else f"[{table}]", "config_block"), i + 1)
            out.append(None)
            i += 1
            continue
        if m := re.match(r"""\s*((?:"(?:[^"\\]|\\.)*"|'[^']*'|[A-Za-z0-9_-]+)(?:\s*\.\s*(?:"(?:[^"\\]|\\.)*"|'[^']*'|[A-Za-z0-9_-]+))*)\s*=""", line):
            j = i  # a value goes on until the lines so far are a document
            while True:
                try:
                    tomllib.loads("\n".join(lines[i : j + 1]) + "\n")
                    break
                except tomllib.TOMLDecodeError:
                    j += 1
                    if j >= len(lines):
                        raise OutlineError("PARSE_ERROR", f"TOML line {i + 1}") from None
            start = len(line) - len(line.lstrip())
            out.append(Symbol(f"{table}.{_bare(m[1])}" if table is not None else _bare(m[1]), "config_block" if table is not None else "constant", i + 1, start, j + 1, len(lines[j].rstrip().encode())))
            i = j
        i += 1
    close(len(lines))
    return out


def yaml(text: str) -> list[Symbol]:
    """Keys as dotted paths to the third level, items of sequences by index, documents by index where there are several."""
    import yaml as y

    lines = re.split(r"\r?\n", text)
    out: list[Symbol] = []
    try:
        docs = [d for d in y.compose_all(text, Loader=y.SafeLoader)]
    except y.YAMLError as e:
        raise OutlineError("PARSE_ERROR", str(e)) from None

    def mark(m) -> tuple[int, int]:
        return m.line + 1, len(lines[m.line][: m.column].encode()) if m.line < len(lines) else 0

    def last(node) -> tuple[int, int]:
        """The end of what a node holds, without the blank lines that block ends run on over."""
        if isinstance(node, y.MappingNode) and node.value and not node.flow_style:
            return last(node.value[-1][1])
        if isinstance(node, y.SequenceNode) and node.value and not node.flow_style:
            return last(node.value[-1])
        if node.start_mark.index == node.end_mark.index:
            return mark(node.start_mark)
        line, col = node.end_mark.line, node.end_mark.column
        while line > node.start_mark.line and not (lines[line][:col] if line < len(lines) else "").strip():
            line -= 1
            col = len(lines[line])
        return line + 1, len(lines[line][:col].encode())

    def pairs(node, prefix: str, depth: int) -> None:
        for k, v in node.value:
            raw = text[k.start_mark.index : k.end_mark.index]
            name = f"{prefix}.{_bare(raw)}" if prefix else _bare(raw)
            empty = isinstance(v, y.ScalarNode) and v.start_mark.index == v.end_mark.index
            end = (mark(k.end_mark)[0], mark(k.end_mark)[1] + 1) if empty else last(v)
            out.append(Symbol(name, "config_block", *mark(k.start_mark), *end))
            if depth < 2 and isinstance(v, y.MappingNode) and len(v.value) <= MAX_CHILDREN:
                pairs(v, name, depth + 1)

    for n, d in enumerate(docs):
        prefix = f"doc[{n}]" if len(docs) > 1 else ""
        if isinstance(d, y.MappingNode):
            pairs(d, prefix, 0)
        elif isinstance(d, y.SequenceNode):
            for k, item in enumerate(d.value):
                at = mark(item.start_mark)
                if not d.flow_style:  # an item begins at its dash
                    back = text.rfind("-", 0, item.start_mark.index)
                    line = text.count("\n", 0, back)
                    at = (line + 1, back - (text.rfind("\n", 0, back) + 1))
                out.append(Symbol(f"{prefix}[{k}]", "config_block", *at, *last(item)))
                if isinstance(item, y.MappingNode):
                    pairs(item, f"{prefix}[{k}]", 1)
    return out


def bash(text: str) -> list[Symbol]:
    """Functions and assignments at the top level."""
    lines = text.split("\n")
    out: list[Symbol] = []
    depth, i, here = 0, 0, None
    opens = re.compile(r"(?:^|[;&|]|\b(?:then|do|else)\b)\s*(if|case|for|while|until|select)\b")
    while i < len(lines):
        line = lines[i].rstrip("\r")
        bare = re.sub(r"""\\.|"(?:[^"\\]|\\.)*"|'[^']*'""", "_", line)
        bare = re.sub(r"(^|\s)#.*", r"\1", bare)
        if here is not None:
            if line.strip() == here:
                here = None
            i += 1
            continue
        if depth == 0:
            if m := re.match(r"\s*(?:function\s+([\w:.-]+)\s*(?:\(\))?|([\w:.-]+)\s*\(\))\s*(\{|$)", line):
                level, j = 0, i
                while j < len(lines):
                    code = re.sub(r"""\\.|"(?:[^"\\]|\\.)*"|'[^']*'|\$\{[^}]*\}""", "_", lines[j])
                    code = re.sub(r"(^|\s)#.*", r"\1", code)
                    level += code.count("{") - code.count("}")
                    if level <= 0 and ("}" in code):
                        break
                    j += 1
                if j >= len(lines):
                    raise OutlineError("PARSE_ERROR", f"Bash line {i + 1}")
                out.append(Symbol(m[1] or m[2], "function", i + 1, len(line) - len(line.lstrip()), j + 1, len(lines[j].rstrip().encode())))
                i = j + 1
                continue
            if m := re.match(r"\s*([A-Za-z_]\w*)(?:\[[^\]]*\])?\+?=", line):
                value = bare[m.end() :] if bare[: m.end()] == line[: m.end()] else ""
                if not re.match(r"\S*\s+[^\s;#&|]", value):  # not the environment of a command
                    out.append(Symbol(m[1], "variable", i + 1, len(line) - len(line.lstrip()), i + 1, len(line.rstrip().encode())))
        depth += len(opens.findall(bare)) - len(re.findall(r"(?:^|[;&|\s])(fi|done|esac)\b", bare))
        if m := re.search(r"<<-?\s*['\"]?(\w+)['\"]?", line):
            here = m[1]
        i += 1
    return out


# --- Python -----------------------------------------------------------------------------------------------------------


def python(text: str) -> list[Symbol]:
    """Classes, functions (methods inside classes) at any depth, and assignments at the module's own level."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        raise OutlineError("PARSE_ERROR", str(e)) from None
    out: list[Symbol] = []

    def add(name: str, kind: str, node: ast.AST) -> None:
        out.append(Symbol(name, kind, node.lineno, node.col_offset, node.end_lineno, node.end_col_offset))

    def targets(t: ast.AST) -> list[str]:
        if isinstance(t, ast.Name):
            return [t.id]
        if isinstance(t, (ast.Tuple, ast.List)):
            return [n for e in t.elts for n in targets(e)]
        return targets(t.value) if isinstance(t, ast.Starred) else []

    todo: list[tuple[ast.AST, bool, bool]] = [(n, False, True) for n in reversed(tree.body)]
    while todo:
        node, inside, top = todo.pop()
        here = inside
        if isinstance(node, ast.ClassDef):
            add(node.name, "class", node)
            here = True
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(node.name, "method" if inside else "function", node)
        elif top and isinstance(node, ast.Assign):
            for t in node.targets:
                for n in targets(t):
                    add(n, "variable", node)
        elif top and isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            add(node.target.id, "variable", node)
        todo.extend((c, here, False) for c in reversed(list(ast.iter_child_nodes(node))))
    return out


PARSERS = {"markdown": markdown, "json": json_outline, "toml": toml, "yaml": yaml, "bash": bash, "python": python}


def outline(path: str, text: str, part: str | None = None) -> list[Symbol]:
    """The symbols of a file, those whose name holds `part` (case aside) if given."""
    from halyard.functions import braces

    lang = language_of(path)
    if len(text.encode("utf-8", "surrogatepass")) > 1 << 20:
        raise OutlineError("FILE_TOO_LARGE", path)
    parser = PARSERS.get(lang) or (lambda t: (braces.ends if lang in ("elixir", "lua", "ruby") else braces.braces)(t, lang))
    return [s for s in parser(text) if part is None or part.lower() in s.name.lower()]
