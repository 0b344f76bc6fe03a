"""Definitions in languages that mark scopes with braces: tokens, then a stack of what each brace opened."""

from __future__ import annotations

import re
from bisect import bisect_right

# File endings by family, words that open a type, statements that look like calls, words before an import.
FAMILIES = {
    "js": (".js", ".jsx", ".ts", ".tsx"), "java": (".java",), "cs": (".cs",), "go": (".go",), "rust": (".rs",),
    "c": (".c", ".cc", ".cpp", ".h", ".hpp"), "php": (".php",),
}
TYPES = {
    "js": ("class", "interface", "enum"), "java": ("class", "interface", "enum", "record"), "cs": ("class", "interface", "struct", "enum", "record"),
    "go": ("type",), "rust": ("struct", "enum", "impl", "trait"), "c": ("class", "struct", "enum", "union"), "php": ("class", "interface", "trait", "enum"),
}
STATEMENTS = frozenset("if for while switch catch do else try finally return new throw sizeof typeof await yield case function fn func".split())
OWN_STATEMENTS = {
    "java": ("synchronized",), "cs": ("foreach", "using", "lock"), "go": ("go", "defer", "select"), "rust": ("match", "unsafe", "loop"),
    "php": ("match", "foreach", "elseif"),
}
IMPORTS = {"js": ("import",), "java": ("import",), "cs": ("using",), "go": ("import",), "rust": ("use",), "c": ("#include",), "php": ("use",)}
FUNCTION = {"js": ("function",), "go": ("func",), "rust": ("fn",), "php": ("function",)}

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRING = r'"(?:\\.|[^"\\\n])*"?'
_WORD = r"#?[A-Za-z_$][\w$]*|\d[\w.]*|=>|->|::|\S"
_CHAR = r"'(?:\\.|[^'\\\n])*'?"
#: Tokens of each family; the first group is text that holds no code.
TOKENS = {
    "js": rf"({_COMMENT}|{_STRING}|{_CHAR}|`(?:\\.|[^`\\])*`?)|{_WORD}",
    "java": rf'({_COMMENT}|"""(?:\\.|[^\\])*?(?:"""|\Z)|{_STRING}|{_CHAR})|{_WORD}',
    "cs": rf'({_COMMENT}|"""+.*?(?:"""+|\Z)|\$?@\$?"(?:""|[^"])*"?|\$?{_STRING}|{_CHAR}|\#(?:region|endregion|if|else|endif|pragma)[^\n]*)|{_WORD}',
    "go": rf"({_COMMENT}|{_STRING}|{_CHAR}|`[^`]*`?)|{_WORD}",
    # a quote may also begin a lifetime
    "rust": rf"""({_COMMENT}|b?r(?P<h>\#*)".*?(?:"(?P=h)|\Z)|b?"(?:\\.|[^"\\])*"?|b?'(?:\\[^\n]{{1,8}}?|[^'\\\n])'|'\w+)|{_WORD}""",
    "c": rf'({_COMMENT}|R"(?P<h>[^(\s]*)\(.*?(?:\)(?P=h)"|\Z)|{_STRING}|{_CHAR}|\#\s*(?!include)[a-z]+(?:\\\n|[^\n])*)|\#\s*include|{_WORD}',
    "php": rf"({_COMMENT}|<\?(?:php|=)?|\?>|\#(?!\[)[^\n]*|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)|{_WORD}",
}
_TOKENS = {k: re.compile(v, re.S) for k, v in TOKENS.items()}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")


def family(path: str) -> str | None:
    """The family of a path's ending; None for other languages."""
    ending = path[path.rfind(".") :].lower() if "." in path else ""
    return next((k for k, v in FAMILIES.items() if ending in v), None)


def tokens(text: str, kind: str) -> list[tuple[str, int]]:
    """(token, offset) of code; comments go, and a string is one token '""'."""
    out, at, find = [], 0, _TOKENS[kind].search
    while m := find(text, at):
        at = m.end()
        if m[1] is not None:
            if not m[1].startswith(("//", "/*", "#", "<?", "?>")) and not (kind == "rust" and re.fullmatch(r"'\w+", m[1])):
                out.append(('""', m.start()))
        elif m[0] == "/" and kind == "js" and (not out or out[-1][0] in ("=", "(", ",", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return")) and (r := _REGEX.match(text, m.start())):
            out.append(('""', m.start()))
            at = r.end()
        else:
            out.append((m[0], m.start()))
    return out


def _statements(kind: str) -> frozenset[str]:
    return STATEMENTS.union(OWN_STATEMENTS.get(kind, ()))


def is_name(token: str) -> bool:
    return bool(_NAME.match(token))


def _flat(head: list[str]) -> list[tuple[str, int]]:
    """(token, place) of head outside brackets, round, square, or angled after a name."""
    out, depth = [], 0
    for i, t in enumerate(head):
        if t in ")]" or (t == ">" and depth):
            depth = max(0, depth - 1)
        if not depth:
            out.append((t, i))
        if t in "([" or (t == "<" and i and is_name(head[i - 1])):
            depth += 1
    return out


def parameters(inside: list[str], kind: str) -> list[str]:
    """Names of a list of parameters: the name before a colon or a type, or after it where types come first."""
    parts, depth, part = [], 0, []
    for t in [*inside, ","]:
        depth += (t in "([{<") - (t in ")]}>")
        if t == "," and depth <= 0:
            parts.append(part)
            part = []
        else:
            part.append(t)
    out = []
    for p in parts:
        ends = [p.index(x) for x in ("=", ":") if x in p]
        names = [t for t in (p[: min(ends)] if ends else p) if is_name(t) and t not in ("mut", "ref", "const", "final", "void")]
        if names:
            out.append(names[-1] if kind in ("java", "cs", "c", "php") or ends or kind == "rust" else names[0])
    return out


def _head(head: list[str], kind: str, in_type: bool) -> tuple[str, str, list[str], str] | None:
    """(name, kind, parameters, type that a method names itself) of the definition that head begins; None for other braces."""
    flat = _flat(head)
    outer = [t for t, _ in flat]
    words = [t for t in outer if is_name(t) or t in ("(", "=", "=>", "::")]
    marks, statements = FUNCTION.get(kind, ()), _statements(kind)
    lead = next((t for t in words if t in TYPES[kind] or t in marks), None)
    first = next((t for t in words if is_name(t)), "")
    if lead in TYPES[kind] and first not in statements and not (kind == "c" and "(" in outer and ":" not in outer) and not (kind == "rust" and "fn" in words):
        i = outer.index(lead)
        rest = outer[i + 1 :]
        if kind == "rust" and lead == "impl":
            # the type stands after `for`, behind type parameters of the impl itself
            rest = rest[rest.index("for") + 1 :] if "for" in rest else rest[rest.index(">") + 1 :] if rest[:1] == ["<"] and ">" in rest else rest
        names = [t for t in rest if is_name(t) and t not in ("class", "struct", "interface", "const", "final")]
        if kind == "go" and not {"struct", "interface"} & set(rest):
            return None
        if names and "new" not in outer[:i] and (kind != "js" or "=" not in outer[:i] or lead == "class"):
            return names[0], "class", [], ""
    opens = [i for i, (t, _) in enumerate(flat) if t == "("]
    if lead in marks and lead:
        i = outer.index(lead)
        receiver = ""
        after = flat[i + 1 :]
        if kind == "go" and after and after[0][0] == "(":
            end = _close(head, after[0][1])
            receiver = next((t for t in reversed(head[after[0][1] : end]) if is_name(t)), "")
            after = [x for x in after if x[1] > end]
        name = next((t for t, _ in after[:2] if is_name(t)), "")
        if not name and kind == "js" and "=" in outer[:i]:
            name = next((t for t in reversed(outer[: outer.index("=")]) if is_name(t)), "")
        at = next((p for t, p in after if t == "("), None)
        if name and at is not None:
            return name, "function", parameters(head[at + 1 : _close(head, at)], kind), receiver
        return None
    if kind == "js" and outer[-1:] == ["=>"] and "=" in outer:
        # an arrow function by the name it is given to
        i = outer.index("=")
        name = next((t for t in outer[:i]if is_name(t) and t not in ("const", "let", "var", "export", "default", "public", "private", "readonly", "static")), "")
        at = next((p for t, p in flat[i + 1 :] if t == "("), None)
        inside = head[at + 1 : _close(head, at)] if at is not None else [t for t in outer[i + 1 : -1] if is_name(t) and t != "async"][-1:]
        return (name, "function", parameters(inside, kind), "") if name else None
    if kind in ("go", "rust", "php") or not opens or first in statements:
        return None
    at = flat[opens[0]][1]
    name, before = (head[at - 1], head[: at - 1]) if at else ("", [])
    if not is_name(name) or name in statements or "=" in outer[: opens[0]] or (kind == "js" and not in_type) or "." in before[-1:]:
        return None
    owner = before[-2] if kind == "c" and before[-1:] == ["::"] and len(before) > 1 else before[-3] if kind == "c" and before[-2:] == ["::", "~"] and len(before) > 2 else ""
    if kind == "c" and not before and not in_type:
        return None
    return name, "function", parameters(head[at + 1 : _close(head, at)], kind), owner


def _close(head: list[str], at: int) -> int:
    depth = 0
    for i in range(at, len(head)):
        depth += (head[i] == "(") - (head[i] == ")")
        if not depth:
            return i
    return len(head)


def definitions(path: str, text: str) -> list[tuple]:
    """(name, kind, path, first line, last line, first column, last column, body, parent, parameters, decorators) by place.

    Kinds are class (any type), function, method (a function inside a type, or that names one as its own) and import.
    A scope that never closes ends with the text.
    """
    kind = family(path)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out, stack, head, depth = [], [], [], 0  # head: tokens with offsets of the statement that is being read

    def place(name, what, a, b, parent, params, marks):
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
        out.append((name, what, path, i + 1, j + 1, a - starts[i], b - starts[j], text[a:b], parent, params, marks))

    def owner() -> str:
        """The innermost type around; each scope knows the one around it."""
        top = stack[-1] if stack else None
        return "" if top is None else top[0][0] if top[0] and top[0][1] == "class" else top[2]

    def decorators(found: list[tuple[str, int]]) -> tuple[list[str], list[tuple[str, int]]]:
        """Leading marks like @Name(..), and the rest of the head."""
        marks = []
        while kind in ("js", "java") and len(found) > 1 and found[0][0] == "@" and found[1][0] != "interface":
            i = 2
            while i + 1 < len(found) and found[i][0] == ".":
                i += 2
            if i < len(found) and found[i][0] == "(":
                i = _close([t for t, _ in found], i) + 1
            end = found[i - 1][1] + len(found[i - 1][0]) if i - 1 < len(found) else len(text)
            marks.append(text[found[0][1] : end])
            found = found[i:]
        return marks, found

    def imported(found: list[tuple[str, int]], end: int) -> None:
        if found and found[0][0].replace(" ", "") in IMPORTS[kind] and not (kind == "cs" and len(found) > 1 and found[1][0] == "(") and not (stack and kind != "rust") and found[1:2] != [("(", found[0][1] + 6)]:
            body = text[found[0][1] : end].rstrip()
            place(body, "import", found[0][1], found[0][1] + len(body), owner(), [], [])

    def closed(end: int) -> list[tuple[str, int]]:
        """Ends the innermost scope; the statement that goes on after it."""
        found, a, parent, params, marks, kept, _ = stack.pop()
        if found:
            spec = found[3] or parent
            what = "method" if found[1] == "function" and spec else found[1]
            place(found[0], what, a, end, spec if what == "method" else parent, params, marks)
        return kept

    line_ends = kind in ("js", "go", "c")
    for t, at in tokens(text, kind):
        if line_ends and head and not depth and head[0][0].replace(" ", "") in IMPORTS[kind] and "\n" in text[head[-1][1] : at] and (kind != "js" or head[-1][0] == '""') and head[-1][0] not in ("{", ","):
            imported(head, text.index("\n", head[-1][1]))
            head = []
        if kind == "go" and head and not depth and head[0][0] in ("type", "var", "const", "package") and "\n" in text[head[-1][1] : at] and t != "{":
            head = []
        if t == "{":
            if head and head[0][0] in ("import", "use") and kind in ("js", "rust"):
                head.append((t, at))
                depth += 1
                continue
            if head and head[0][0] == "export" and len(head) == 1:
                head.append((t, at))
                depth += 1
                continue
            # what opens inside brackets is a value
            marks, rest = decorators(head) if not depth else ([], head)
            found = None if depth else _head([x for x, _ in rest], kind, bool(stack and stack[-1][0] and stack[-1][0][1] == "class"))
            inner = depth > 0 or (not found and bool(head) and head[-1][0] in ("=", "=>", ",", ":", "return", "?"))
            begin = next((p for x, p in rest if x not in ("export", "default")), at) if kind == "js" else rest[0][1] if rest else at
            if inner:
                head += [("{", at), ("}", at)]
            stack.append((found, begin, owner(), found[2] if found else [], marks, head if inner else [], depth))
            head, depth = [], 0
        elif t == "}":
            if head and head[0][0] in ("import", "use", "export") and depth:
                head.append((t, at))
                depth -= 1
            elif stack:
                depth = stack[-1][-1]
                head = closed(at + 1)
        elif t == ";" and not depth:
            imported(head, at + 1)
            found = _head([x for x, _ in head], kind, False) if kind == "rust" and any(x == "struct" for x, _ in head[:4]) else None
            if found:
                place(found[0], "class", head[0][1], at + 1, owner(), [], [])
            head = []
        elif t == "," and not depth and head and head[-1][0] == "}" and head[0][0] not in ("import", "use", "export"):
            head = []
        else:
            if kind == "c" and t == ":" and len(head) == 1 and head[0][0] in ("public", "private", "protected"):
                head = []
                continue
            depth = max(0, depth + (t in "([") - (t in ")]")) if t in "()[]" else depth
            head.append((t, at))
    imported(head, len(text))
    while stack:
        closed(len(text.rstrip()))
    return sorted(out, key=lambda r: (r[3], r[5], -r[4]))


def calls(body: str, kind: str) -> list[str]:
    """Names followed by an opening bracket outside comments and strings, but for those that a definition names."""
    found = tokens(body, kind)
    defined, statements = FUNCTION.get(kind, ()), _statements(kind)
    return sorted({a for i, ((a, _), (b, _)) in enumerate(zip(found, found[1:], strict=False)) if b == "(" and is_name(a) and a not in statements and not (i and found[i - 1][0] in defined)})


_DECISIONS = frozenset("if for while case catch".split())


def complexity(body: str, kind: str) -> int:
    """Decisions in the code itself, not in its comments and strings, and one: branches, loops, cases, handlers, and, or, conditional values."""
    found = [t for t, _ in tokens(body, kind)]
    pairs = sum(a == b and a in "&|" for a, b in zip(found, found[1:], strict=False))
    choices = sum(t == "?" and n not in (".", ":", ")", ",", "?", ";", ">") for t, n in zip(found, found[1:], strict=False)) if kind != "rust" else 0
    more = {"foreach", "elseif", "match"}.intersection(OWN_STATEMENTS.get(kind, ()))
    return 1 + sum(t in _DECISIONS or t in more for t in found) + pairs + choices
