"""A pushdown parser of C-like code with templates and JSX: comments, strings, template fragments and text nodes with their context.

It reads tokens once, from left to right, with a stack of the constructs that are open: blocks, object literals, calls and
constructors with their names, parentheses, brackets, templates with their expressions, elements, tags.  Each construct knows what
it is nested in up to the statement's block, so the place of a string is judged by the whole expression around it, however long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from lexloom import fixed_values as V

_HAN = re.compile(V.HAN_CHARS)
MARKUP, JSX = (".vue", ".svelte"), (".jsx", ".tsx", ".js", ".mjs", ".vue", ".svelte")
SCRIPTS = (".js", ".jsx", ".mjs", ".ts", ".tsx", ".vue", ".svelte")
_INCLUDES = (".c", ".cpp", ".h")
_GENERIC = (".ts", ".tsx", ".java", ".kt", ".cs", ".cpp")

_TOKEN = re.compile(r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|=>|->|\?\.|\+\+|--|\S")
_STRINGS = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}", re.S) for q in "\"'"}
_CHARACTER = re.compile(r"'(?:\\[^\n]{1,9}?|[^'\\\n])'")
_TRIPLE = re.compile(r'"""(.*?)"""(?!")', re.S)
_RAW = re.compile(r'r(#*)"(.*?)"\1', re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TYPES = re.compile(r"<[\w$\s,.|&?\[\]]*>(?=\s*\()")
_TAG = re.compile(r"</?([^\W\d_][\w.:-]*)?")
_NAME = re.compile(r"[^\s=>\"'{}/]+")
_INCLUDE = re.compile(r'#[ \t]*include[ \t]*"([^"\n]*)"')
_AFTER_KEY = re.compile(r"\s*:")

# Words of the languages that are operators, begin statements or declarations, or stand before a parenthesis.
_OPERATORS = {"return", "typeof", "case", "in", "of", "do", "else", "default", "yield", "await", "void", "delete", "instanceof", "new", "throw", "extends", "when"}
_DECLARED = {"const", "let", "var", "function", "class", "interface", "type", "enum", "async", "abstract", "namespace", "declare"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "match", "when", "function", "fn", "func", "fun"}


class Found(NamedTuple):
    start: int
    end: int
    kind: str
    translatable: bool = True
    reason: str = ""
    protected: list[str] | None = None


class Context(NamedTuple):
    """What a place lies in, up to the block of its statement: the nearest call, whether any is an error's constructor or loads a module."""

    call: tuple[str, str] | None = None  # object and name
    error: bool = False
    module: bool = False


def is_constant(body: str) -> bool:
    """Capitals, digits and underscores only."""
    return bool(body) and all(c == "_" or c.isupper() or c.isdecimal() for c in body)


def classify(body: str, around: Context, key: bool = False, attribute: str | None = None) -> tuple[bool, str]:
    """Whether a string is to be translated, and why; the first rule that fits counts."""
    han = bool(_HAN.search(body))
    if key:
        return False, "object key"
    if around.module:
        return False, "import/module source"
    if attribute is not None:
        name = attribute.lower()
        if name == "classname":
            return False, "className"
        if name.startswith("data-test"):
            return False, "test selector"
        return (True, "shown attribute") if name in V.UI_ATTRIBUTES else (han, "attribute")
    if around.call is not None:
        of, name = around.call
        if name in V.ROUTE_CALLS:
            return False, "route/endpoint"
        if of == "console":
            return han, "console"
    if around.error:
        return han, "error message"
    if not han and is_constant(body):
        return False, "machine constant"
    return han, "text" if han else "no Han characters"


@dataclass
class Frame:
    """An open construct; ``within`` is what its content lies in, ``block`` the block of its statement."""

    kind: str
    within: Context = Context()
    block: Frame | None = None
    #: Of a block: its statement's first words, and whether the next token begins one.
    first: list[str] = field(default_factory=list)
    fresh: bool = True
    #: Of a template: its fragments, the texts of its expressions, and where the present one of either began.
    parts: list[tuple[int, int]] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    edge: int = 0
    #: Of a parenthesis: it belongs to a statement (if, while), so no value ends with it.
    control: bool = False


class Lexer:
    def __init__(self, text: str, suffix: str):
        self.text, self.suffix, self.out = text, suffix, []
        top = Frame("block")
        top.block = top
        self.stack = [top]
        #: The last token, whether a value ends with it, the names of the chain that ends with it, and a pending ``new``.
        self.last, self.operand, self.chain, self.new = "", False, [], False
        self.before = ""  # the word before the chain

    def run(self) -> list[Found]:
        if self.suffix in MARKUP:
            self._document()
        else:
            at, modes = 0, {"template": self._template, "tag": self._tag, "children": self._children}
            while at < len(self.text):
                at = modes.get(self.stack[-1].kind, self._code)(at)
            for frame in self.stack:
                if frame.kind == "template":  # it has no end: what was read of it counts
                    self._fragments(frame, min(len(self.text), max(frame.edge, len(self.text))) if frame is self.stack[-1] else None)
        return sorted(self.out, key=lambda x: (x.start, x.end))

    def _add(self, start: int, end: int, kind: str, translatable: bool = True, reason: str = "", protected: list[str] | None = None) -> None:
        if end > start:
            self.out.append(Found(start, end, kind, translatable, reason, protected))

    # what is open

    def _push(self, kind: str, within: Context | None = None, **more) -> Frame:
        above = self.stack[-1]
        frame = Frame(kind, self._around() if within is None else within, above.block, **more)
        if kind == "block":
            frame.block, frame.within = frame, Context()
        self.stack.append(frame)
        return frame

    def _around(self) -> Context:
        """What the present place lies in."""
        top = self.stack[-1]
        return top.within._replace(module=top.within.module or self._module_statement(top.block))

    @staticmethod
    def _module_statement(block: Frame) -> bool:
        first = block.first
        if not first:
            return False
        if first[0] == "import":
            return first[1:2] not in (["("], ["."])
        return first[0] == "export" and not (_DECLARED & set(first[1:3]))

    def _token(self, text: str, operand: bool) -> None:
        """Notes a token that has been read; the first ones of a statement are kept with its block."""
        top = self.stack[-1]
        if top.kind == "block":
            if top.fresh:
                top.first, top.fresh = [], False
            if len(top.first) < 3:
                top.first.append(text)
        self.last, self.operand = text, operand

    def _ended(self, close: str, operand: bool) -> None:
        self.last, self.operand, self.chain, self.new = close, operand, [], False

    # code

    def _code(self, at: int) -> int:
        text, m = self.text, _TOKEN.search(self.text, at)
        if m is None:
            return len(text)
        top, start, sign = self.stack[-1], m.start(), m[0]
        if text.startswith("//", start) or text.startswith("/*", start):
            return self._comment(start)
        if top.kind == "block" and not top.fresh and self.operand and (m["word"] or sign in "\"'`{") and "\n" in text[at:start] and sign != "from":
            top.fresh = True  # no value goes on with a word on the next line
            if sign != "{":
                self.chain = []
        if m["word"]:
            return self._word(m)
        if m["number"]:
            self._token(sign, True)
            self.chain = []
            return m.end()
        if sign in "\"'":
            return self._string(start)
        if sign == "`":
            return self._open_template(start)
        if sign in "([{":
            self._open(sign, start)
            return m.end()
        if sign in ")]}":
            self._close(sign, start)
            return m.end()
        if sign == "/" and not self.operand and (found := _REGEX.match(text, start)):
            self._token("/", True)
            return found.end()
        if sign == "<":
            if self.suffix in JSX and not self.operand and re.match(r"<(?:[^\W\d_]|>)", text[start : start + 2]):
                self._push("tag", edge=start)
                return start
            if self.suffix in _GENERIC and self.chain and (found := _TYPES.match(text, start)):
                return found.end()
        if sign == "#" and self.suffix in _INCLUDES and (found := _INCLUDE.match(text, start)):
            self._add(*found.span(1), "string", False, "import/module source")
            return found.end()
        if sign in (".", "?.", "::"):
            self.last = "."
            return m.end()
        if sign == ";" and top.kind == "block":
            top.fresh = True
        self._token(sign, sign in ("++", "--"))
        if sign == ";" and top.kind == "block":
            top.first, top.fresh = [], True
        self.chain, self.new = [], False
        return m.end()

    def _comment(self, at: int) -> int:
        line = self.text.startswith("//", at)
        end = self.text.find("\n" if line else "*/", at + 2)
        end = len(self.text) if end < 0 else end if line else end + 2
        if _HAN.search(self.text, at, end):
            self._add(at, end, "line_comment" if line else "doc_comment" if self.text.startswith("/**", at) else "block_comment")
        return end

    def _word(self, m: re.Match) -> int:
        word = m[0]
        if word == "r" and self.suffix == ".rs" and (raw := _RAW.match(self.text, m.start())):
            self._literal(*raw.span(2))
            return raw.end()
        if self.last == "." and self.chain:
            self.chain.append(word)
        elif self.last == ".":
            self.chain = ["", word]  # a member of something that is no name
        else:
            self.before, self.chain = (self.chain[-1] if self.chain else ""), [word]
        if word == "new" and len(self.chain) == 1:
            self._token(word, False)
            self.new, self.chain = True, []
            return m.end()
        self._token(word, len(self.chain) > 1 or word not in _OPERATORS)
        return m.end()

    def _open(self, sign: str, at: int) -> None:
        if sign == "{":
            self._push("block" if self._is_block() else "object")
            self._ended("{", False)
            return
        called = sign == "(" and (self.operand or self.last in ("import", "super"))
        names, new, before, last = self.chain, self.new, self.before, self.last
        self._token(sign, False)
        if not called or len(names) == 1 and (names[0] in _CONTROL or before in _CONTROL - {"if", "when"}):
            self._push("paren" if sign == "(" else "index", control=called and names[:1] != [] and names[0] in _CONTROL)
        else:
            around, name = self._around(), names[-1] if names and last == names[-1] else ""
            failure = "Error" in name or "Exception" in name
            if new:
                within = around._replace(error=around.error or failure)
            else:
                failure = failure and self.suffix in (".kt", ".rs", ".go")  # constructors without a word of their own
                within = Context((".".join(names[:-1]), name), around.error or failure, around.module or names in (["require"], ["import"]))
            self._push("call", within)
        self._ended(sign, False)

    def _is_block(self) -> bool:
        """Whether a brace at this place opens statements rather than a value."""
        top, last = self.stack[-1], self.last
        if top.kind == "block" and top.fresh:
            return True
        if top.kind == "block" and top.first[:1] in (["import"], ["export"]) and last in ("import", "export", "type", ","):
            return False  # the names of a module
        if last in (")", "=>", "->", ";", "do", "else", "try", "finally", "{", "}"):
            return last != "{" or top.kind == "block"
        if last == ":" and top.kind == "block":
            return top.first[:1] in (["case"], ["default"])
        if self.operand:  # after a name: a class or namespace in statements, a composite value inside an expression
            return top.kind == "block" and (self.suffix in SCRIPTS or top.first[:1] not in (["return"],) and "=" not in top.first)
        return False

    def _close(self, sign: str, at: int) -> None:
        kinds = {")": ("paren", "call"), "]": ("index",), "}": ("block", "object", "subst", "expression")}[sign]
        if self.stack[-1].kind not in kinds or len(self.stack) == 1:
            self._token(sign, True)  # nothing of the kind is open here
            self.chain = []
            return
        closed = self.stack.pop()
        top = self.stack[-1]
        if closed.kind == "subst":
            top.held.append(self.text[closed.edge : at + 1])
            top.edge = at + 1
            return
        if closed.kind == "expression":
            return
        self._ended(sign, closed.kind != "block" and not closed.control)
        if closed.kind == "block" and top.kind == "block":
            top.fresh = True  # so that what follows a block begins a statement
            top.first = [] if top.first[:1] not in (["export"], ["import"]) else top.first

    # strings

    def _string(self, at: int) -> int:
        text, quote = self.text, self.text[at]
        if quote == "'" and self.suffix not in SCRIPTS:
            m = _CHARACTER.match(text, at)
            self._token("'", bool(m))
            return m.end() if m else at + 1
        if self.suffix in (".kt", ".java", ".cs") and (m := _TRIPLE.match(text, at)):
            self._literal(*m.span(1))
            return m.end()
        m = _STRINGS[quote].match(text, at)
        if m is None:
            return at + 1
        top = self.stack[-1]
        key = self.suffix in SCRIPTS and top.kind == "object" and self.last in ("{", ",") and bool(_AFTER_KEY.match(text, m.end()))
        self._literal(at + 1, m.end() - 1, key)
        return m.end()

    def _literal(self, start: int, end: int, key: bool = False) -> None:
        top, body = self.stack[-1], self.text[start:end]
        fresh = top.kind == "block" and top.fresh
        if fresh:
            top.first, top.fresh = [], False
        source = top.kind == "block" and self.last == "from" and top.first[:1] == ["export"]
        around = self._around()
        if body.strip():
            self._add(start, end, "string", *classify(body, around._replace(module=True) if source else around, key))
        self._token('"', True)
        self.chain, self.new = [], False
        if top.kind == "block" and top.first[:1] == ["import"]:
            top.fresh = True  # the module's name ends the statement

    def _open_template(self, at: int) -> int:
        text = self.text
        if self.suffix == ".go":
            end = text.find("`", at + 1)
            end = len(text) if end < 0 else end
            self._literal(at + 1, end)
            return end + 1
        around = self._around()
        self._token("`", True)
        self._push("template", around, edge=at + 1)
        self.chain = []
        return at + 1

    def _template(self, at: int) -> int:
        text, top = self.text, self.stack[-1]
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                self.stack.pop()
                self._fragments(top, at)
                self._ended("`", True)
                return at + 1
            elif text.startswith("${", at):
                top.parts.append((top.edge, at))
                top.edge = at
                self._push("subst", edge=at)
                self._ended("{", False)
                return at + 2
            else:
                at += 1
        return at

    def _fragments(self, template: Frame, end: int | None) -> None:
        for a, b in [*template.parts, *([(template.edge, end)] if end is not None else [])]:
            told = classify(self.text[a:b], template.within)
            told = (told[0], "no Han characters") if told[1] == "machine constant" else told
            self._add(a, b, "template_string_fragment", *told, template.held or None)

    # elements

    def _tag(self, at: int) -> int:
        """The tag that begins at, or goes on at ``at``; an expression inside it is read as code."""
        text, top = self.text, self.stack[-1]
        if at == top.edge:
            m = _TAG.match(text, at)
            top.parts, top.held, at = [], ["closing" if text.startswith("</", at) else "", ""], m.end()
        while at < len(text):
            c = text[at]
            if c == ">":
                self.stack.pop()
                if top.held[0]:
                    if self.stack[-1].kind == "children":
                        self.stack.pop()
                elif text[at - 1] != "/":
                    self._push("children", top.within)
                    return at + 1
                self._ended(">", True)
                return at + 1
            if c == "{":
                top.edge = -1
                self._push("expression", top.within)
                self._ended("{", False)
                return at + 1
            if c in "\"'":
                at = self._value(at, top.held[1], top.within)
            elif c.isspace() or c in "=/}":
                at += 1
            else:
                m = _NAME.match(text, at)
                top.held[1], at = m[0], m.end()
        return at

    def _value(self, at: int, name: str, around: Context) -> int:
        """An attribute's value, which may run over lines and has no escapes."""
        end = self.text.find(self.text[at], at + 1)
        if end < 0:
            return at + 1
        if self.text[at + 1 : end].strip():
            self._add(at + 1, end, "string", *classify(self.text[at + 1 : end], around, attribute=name))
        return end + 1

    def _children(self, at: int) -> int:
        text = self.text
        if text[at] == "{":
            self._push("expression")
            self._ended("{", False)
            return at + 1
        if text[at] == "<" and re.match(r"</|<(?:[^\W\d_]|>)", text[at : at + 2]):
            self._push("tag", edge=at)
            return at
        m = re.compile(r"[<{]").search(text, at + 1)
        end = m.start() if m else len(text)
        self._text(at, end)
        return end

    def _text(self, start: int, end: int) -> None:
        body = self.text[start:end]
        if body.strip():
            start += len(body) - len(body.lstrip())
            han = bool(_HAN.search(body))
            self._add(start, start + len(body.strip()), "jsx_text", han, "text" if han else "no Han characters")

    def _document(self) -> None:
        """A markup document: text nodes and attributes, code in script elements; style elements and comments are passed over."""
        text, at = self.text, 0
        while at < len(text):
            if text.startswith("<!--", at):
                end = text.find("-->", at)
                at = len(text) if end < 0 else end + 3
            elif text[at] == "<" and (m := re.compile(r"</?([^\W\d_][\w.:-]*)").match(text, at)):
                closing, name, at = text.startswith("</", at), m[1].lower(), self._attributes(m.end())
                if not closing and name in ("script", "style") and text[at - 2 : at] != "/>":
                    end = re.compile(rf"</{name}", re.I).search(text, at)
                    stop = end.start() if end else len(text)
                    if name == "script":
                        inside = Lexer(text[at:stop], ".ts").run()
                        self.out += [f._replace(start=f.start + at, end=f.end + at) for f in inside]
                    at = stop
            else:
                end = text.find("<", at + 1)
                end = len(text) if end < 0 else end
                self._text(at, end)
                at = end

    def _attributes(self, at: int) -> int:
        """Reads a document's tag to its end."""
        text, name = self.text, ""
        while at < len(text) and text[at] != ">":
            if text[at] in "\"'":
                at = self._value(at, name, Context())
            elif m := _NAME.match(text, at):
                name, at = m[0], m.end()
            else:
                at += 1
        return at + 1
