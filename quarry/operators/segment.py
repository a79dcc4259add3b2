"""Functions of C-like source text, by one linear pass.

The text is cut into tokens (comments, literals and preprocessor lines say nothing; every
pattern is possessive, so no character is read twice).  A push-down automaton reads the tokens
between two declarations, the *head*: a closed bracket becomes one token of the list that it
stands in.  At a brace the head is read once and opens a scope (namespace, linkage block,
class), a function, or a block that is passed over by counting braces.

A head is a function's if it has a name with a parameter list, not an attribute or a keyword,
that follows a type (``int f(void)``), is qualified (``A::f()``), an operator or a destructor, or
stands without a type but is not all upper case (``main()``) or names its class.  What comes
after (qualifiers, attributes, macros, a trailing type, a constructor's initialisers, the
declarations of an old-style parameter list) does not matter.

Of a preprocessor conditional later branches count only if the branch before left the automaton
where it was, so a head or a brace that stands in every branch counts once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMMENT = r"//(?:[^\n\\]|\\.)*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_HIDDEN = rf"""{_COMMENT}|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?"""
_NUMBER = r"\b\d(?:'?[\w.])*+"
_RAW = r'(?:\b(?:u8|[uUL])?R)"(?P<tag>[^()\\\s"]{0,16})\('
_LINE = rf'^[ \t]*+\#[ \t]*+(?P<word>\w*+)(?:{_COMMENT}|"(?:[^"\\\n]|\\.)*+"?|[^\n\\]|\\.)*+'
_HEAD = re.compile(rf"(?P<line>{_LINE})|(?P<raw>{_RAW})|(?P<num>{_NUMBER})|(?P<hidden>{_HIDDEN})|(?P<id>[^\W\d][\w$]*+)|(?P<op>::|->|[^\s\w])", re.M | re.S)
_BODY = re.compile(rf"(?P<line>{_LINE})|(?P<raw>{_RAW})|(?P<num>{_NUMBER})|(?P<hidden>{_HIDDEN})|(?P<op>[{{}}])", re.M | re.S)

#: Words that a bracket can follow without being a declarator's name.
_NOT_NAMES = set("if for while switch catch sizeof defined static_assert _Static_assert alignas _Alignas alignof _Alignof noexcept requires decltype typeof __typeof__ __typeof __attribute__ __attribute __declspec asm __asm__ __asm _Pragma explicit throw".split())
_TYPE_CALLS = {"decltype", "typeof", "__typeof__", "__typeof"}
#: Words of statements: what they stand in declares no function.
_STATEMENT = set("return else do case goto new delete if for while switch catch".split())
#: Words before a declarator that are no type.
_STORAGE = set("static extern inline __inline __inline__ __forceinline virtual friend constexpr consteval constinit typedef register thread_local _Thread_local _Noreturn __extension__ const volatile mutable explicit __attribute__ __attribute __declspec alignas _Alignas _Pragma".split())
_TYPES = set("void char short int long float double signed unsigned bool _Bool auto".split())
_CLASS = {"class", "struct", "union"}
_ACCESS = {"public", "private", "protected", "signals", "slots"}
_OPENS = {"(": ")", "[": "]", "<": ">"}
_GROUPS = {"(": "()", "[": "[]", "<": "<>"}

# a token: kind ('id', 'op', 'str', '()', '[]', '<>', '{}'), its text (of a bracket: the tokens in it), its place
ID, OP, STR = "id", "op", "str"


def _upper(name: str) -> bool:
    return len(name) > 1 and name == name.upper() and name != name.lower()


def _names_only(group: list) -> bool:
    """A list of one or more names with commas between."""
    return bool(group) and all(t[0] == ID if i % 2 == 0 else t[1] == "," for i, t in enumerate(group)) and len(group) % 2 == 1


class _Head:
    """Tokens since the last declaration, in a stack of open brackets."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[str, int, list]] = [("", -1, [])]  # bracket, its place, tokens
        self.function: tuple | None = None  # found at an earlier brace, in front of initialisers
        self.old: tuple[set, int] | None = None  # names of an old-style parameter list, where its next declaration starts

    @property
    def tokens(self) -> list:
        return self.levels[0][2]

    def add(self, kind: str, text, at: int) -> None:
        out = self.levels[-1][2]
        if kind == ID and len(self.levels) == 1 and out and out[-1][0] == "()" and not self.old and _names_only(out[-1][1]):
            self.old = ({t[1] for t in out[-1][1]}, len(out))
        out.append((kind, text, at))

    def punctuation(self, ch: str, at: int) -> None:
        levels, out = self.levels, self.levels[-1][2]
        if ch in "([" or ch == "<" and len(levels) == 1 and out and out[-1][0] == ID and out[-1][1] != "operator":
            levels.append((ch, at, []))
        elif ch == ">" and levels[-1][0] == "<":
            self._close()
        elif ch in ")]":
            while levels[-1][0] == "<":
                self._spill()
            if levels[-1][0] and _OPENS[levels[-1][0]] == ch:
                self._close()
        else:
            self.add(OP, ch, at)

    def _close(self) -> None:
        ch, at, inner = self.levels.pop()
        self.add(_GROUPS[ch], inner, at)

    def _spill(self) -> None:
        """An angle that was no bracket: its tokens belong to the level around it."""
        ch, at, inner = self.levels.pop()
        self.levels[-1][2].extend([(OP, ch, at), *inner])

    def at_brace(self) -> None:
        while self.levels[-1][0] == "<":
            self._spill()

    def ends(self, at: int) -> None:
        """A semicolon: the end of the head, but for declarations of old-style parameters."""
        if len(self.levels) == 1 and self.old:
            names, since = self.old
            if any(t[0] == ID and t[1] in names or t[0] == "()" and any(x[0] == ID and x[1] in names for x in t[1]) for t in self.tokens[since:]):
                self.add(OP, ";", at)
                self.old = (names, len(self.tokens))
                return
        self.clear()

    def state(self) -> tuple[int, int]:
        return len(self.levels), len(self.levels[-1][2])


def _chain(tokens: list, i: int) -> tuple[list[str], int]:
    """Qualified name from ``i`` on (without template arguments) and the place after it."""
    names, n = [tokens[i][1]], len(tokens)
    i += 1
    while True:
        j = i + 1 if i < n and tokens[i][0] == "<>" else i
        if j + 1 < n and tokens[j][1] == "::":
            if tokens[j + 1][0] == ID:
                names.append(tokens[j + 1][1])
                i = j + 2
                if names[-1] == "operator":
                    return names, i
                continue
            if j + 2 < n and tokens[j + 1][1] == "~" and tokens[j + 2][0] == ID:
                names.append("~" + tokens[j + 2][1])
                i = j + 3
                continue
        return names, j


def _operator(tokens: list, i: int) -> tuple[str, int]:
    """Symbol or type after ``operator`` and the place of the parameter list."""
    if i + 1 < len(tokens) and tokens[i][0] == "()" and not tokens[i][1] and tokens[i + 1][0] == "()":
        return "()", i + 1
    out = ""
    while i < len(tokens) and tokens[i][0] != "()":
        kind, text, _ = tokens[i]
        out += f" {text}" if kind == ID else kind if kind in ("[]", "<>") else '""' if kind == STR else text
        i += 1
    return out, i


def _read_head(tokens: list, text: str, owner: str) -> tuple:
    """('function', name, start, plain), ('scope', class name) or ('block',) of a head.

    ``owner``: the class that the head stands in.  ``plain``: the declarator is a bare name."""
    i, n, start = 0, len(tokens), 0
    typed = starred = False
    kind = class_name = ""
    linkage = False
    weak: tuple | None = None
    old_style = any(t[1] == ";" for t in tokens)

    def found(names: list[str], at: int, strong: bool, plain: bool) -> tuple:
        name = "::".join(names)
        if strong or not _upper(name) or name == owner:
            return ("function", name, tokens[at][2], plain and len(names) == 1 and not starred and not (owner and strong))
        return ("block",)

    while i < n:
        what, word, at = tokens[i]
        if what == OP and word == "=":
            return ("block",)
        if what == ID and word == "template" and i + 1 < n and tokens[i + 1][0] == "<>":
            i += 2
            start = i
        elif what == ID and word == "extern" and i + 1 < n and tokens[i + 1][0] == STR:
            linkage, i = True, i + 2
            start = i
        elif what == ID and word in _ACCESS and i + 1 < n and tokens[i + 1][1] in (":", "slots"):
            i += 2 + (tokens[i + 1][1] == "slots")
            start = i
        elif what == ID and word == "operator":
            symbol, j = _operator(tokens, i + 1)
            return found(["operator" + symbol], start, True, False) if j < n else ("block",)
        elif what == ID:
            if word in _STATEMENT:
                return ("block",)
            names, j = _chain(tokens, i)
            if names[-1] == "operator":
                symbol, j = _operator(tokens, j)
                return found([*names[:-1], "operator" + symbol], start, True, False) if j < n else ("block",)
            if j < n and tokens[j][0] == "()" and not (word in _CLASS or word in _TYPES or _is_declarator(tokens, j) and not typed):
                if len(names) == 1 and word in _NOT_NAMES:
                    typed |= word in _TYPE_CALLS
                elif kind and not class_name:
                    pass  # a macro between the keyword and the name
                elif typed or len(names) > 1:
                    return found(names, start, True, True)
                elif j + 1 < n and tokens[j + 1][0] == ID and not old_style and tokens[j + 1][1] not in ("const", "noexcept", "override", "final", "try", "volatile"):
                    if "\n" in text[at : tokens[j + 1][2]]:  # a macro on a line of its own, before the declaration
                        start, typed, weak = j + 1, False, weak or ([word], start)
                    else:  # a macro that makes the type
                        weak, typed = weak or (names, start), True
                else:
                    return found(names, start, False, True)
                i = j + 1
                continue
            if len(names) == 1 and (word in _CLASS or word in ("enum", "namespace")):
                kind = kind or word
            elif word not in _STORAGE and word != "final":
                class_name = names[-1]
            typed |= word not in _STORAGE and word not in _NOT_NAMES
            i = max(j, i + 1)
        elif what == "()":
            inner = tokens[i][1]
            k = next((k for k, t in enumerate(inner) if t[0] == ID and t[1] not in _STORAGE), None)
            if typed and k is not None and all(t[1] in ("*", "&") or t[0] == ID for t in inner[:k]):
                names, j = _chain(inner, k)
                if j < len(inner) and inner[j][0] == "()":  # returns a pointer to a function
                    return found(names, start, True, False)
                if j == len(inner) and k == 0 and i + 1 < n and tokens[i + 1][0] == "()":  # (f)(void)
                    return found(names, start, True, False)
            i += 1
        elif what == OP and word == "~" and i + 2 < n and tokens[i + 1][0] == ID and tokens[i + 2][0] == "()":
            return found(["~" + tokens[i + 1][1]], start, True, False)
        elif what == OP and word == ":" and kind:
            break  # bases
        else:
            starred |= what == OP and word in "*&"
            i += 1
    if kind in _CLASS:
        return ("scope", class_name)
    if kind == "namespace" or linkage:
        return ("scope", "")
    if weak and not kind:
        return found(*weak, False, True)
    return ("block",)


def _is_declarator(tokens: list, i: int) -> bool:
    """The bracket at ``i`` holds a pointer declarator and its parameters follow."""
    inner = tokens[i][1]
    return bool(inner) and inner[0][1] in ("*", "&") and i + 1 < len(tokens) and tokens[i + 1][0] == "()"


def _initialises(tokens: list) -> bool:
    """The brace after these tokens is an initialiser of a constructor, not its body."""
    colon = next((i for i, t in enumerate(tokens) if t[1] == ":" and i and tokens[i - 1][0] in ("()", ID)), None)
    return colon is not None and any(t[0] == "()" for t in tokens[:colon]) and tokens[-1][0] in (ID, "<>") and tokens[-1][1] != "try"


def find_functions(text: str, names: str = "full") -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, code) of each function in C-like source, in order.

    ``names="shallow"`` names a function only where its declarator is a bare name, and calls
    others 'anonymous' (functions that return pointers, qualified names, methods).
    A closing brace without an opening one is ignored, a function without an end too."""
    head, scopes, found, branches = _Head(), [], [], []
    skip, body, pos, counted, line = 0, None, 0, 0, 1
    off = 0  # conditionals opened inside a branch that is left out, that one included
    while True:
        m = (_BODY if skip or off else _HEAD).search(text, pos)
        if not m:
            return found
        pos, kind = m.end(), m.lastgroup
        if kind == "raw":
            end = text.find(f'){m["tag"]}"', pos)
            pos = len(text) if end < 0 else end + len(m["tag"]) + 2
        elif kind == "line":
            word, here = m["word"], (len(scopes), skip, head.state())
            if word in ("if", "ifdef", "ifndef"):
                off += off > 0
                if not off:
                    branches.append(here)
            elif word == "endif":
                off = max(0, off - 1)
                if not off and branches:
                    branches.pop()
            elif word in ("else", "elif", "elifdef", "elifndef") and not off and branches and branches[-1] != here:
                off = 1
        elif off:
            continue
        elif kind == "hidden":
            if not skip and m["hidden"][0] == '"':
                head.add(STR, m["hidden"], m.start())
        elif kind == "num":
            if not skip:
                head.add("num", "", m.start())
        elif skip:
            skip += 1 if m["op"] == "{" else -1
            if skip:
                continue
            if body == "brace":  # inside a head
                head.add("{}", "", m.start())
            else:
                if body:
                    name, begin, plain = body
                    line += text.count("\n", counted, begin)
                    counted = begin
                    found.append((name if names == "full" or plain else "anonymous", line, line + text.count("\n", begin, m.start()), text[begin : m.end()]))
                head.clear()
            body = None
        elif kind == "id":
            head.add(ID, m["id"], m.start())
        elif m["op"] == ";":
            head.ends(m.start())
        elif m["op"] == "}":
            if scopes:
                scopes.pop()
            head.clear()
        elif m["op"] == "{":
            head.at_brace()
            if len(head.levels) > 1 or head.tokens and head.function and head.tokens[-1][0] in (ID, "<>") or head.tokens and not head.function and _initialises(head.tokens):
                if len(head.levels) == 1 and not head.function:
                    head.function = _read_head(head.tokens, text, scopes[-1] if scopes else "")
                skip, body = 1, "brace"
                continue
            what = head.function or _read_head(head.tokens, text, scopes[-1] if scopes else "")
            if what[0] == "scope":
                scopes.append(what[1])
                head.clear()
            else:
                skip, body = 1, what[1:] if what[0] == "function" else None
        else:
            head.punctuation(m["op"], m.start())


#: Bytes of functions that a task holds before it hands them on.
BATCH_BYTES = 4 << 20


def segment_units(files: DataFrame, path: str = "path", content: str = "content", names: str = "full") -> DataFrame:
    """Source text -> functions: file_path, function_name, start_line, end_line, code.

    A file is one row and is read in one pass, whatever its size, so there is no shuffle; a
    task hands on its functions in batches of bounded size.  Null content has no function;
    repeated rows give repeated functions; the ingestion's size rule is
    ``corpus.accepted_files``."""
    schema = "file_path string, function_name string, start_line long, end_line long, code string"
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        rows, held = [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], cols)

        for batch in batches:
            for at, source in zip(batch.column(0), batch.column(1)):
                for row in find_functions(source.as_py() or "", names):
                    rows.append((at.as_py(), *row))
                    held += len(row[3])
                    if held >= BATCH_BYTES:
                        yield emit()
                        rows, held = [], 0
        yield emit()

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)
