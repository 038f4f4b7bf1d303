"""Linear facts of one source text: what a per-file pass with a stack can tell without types.

``linearise(text)`` gives rows (dicts) of five kinds, in evaluation order:

* ``expr``: ``id``; ``what`` literal, concat, name, call, new or other; ``value`` (a literal's raw
  contents, or a name's qualifier), ``name`` (of a name, method or created type), ``scope``
  (id of the receiver), ``root`` (id at the left end of the call chain), ``args`` (ids of operands or
  arguments), ``type`` (a literal's type, or a local's or parameter's declared type at this place); a
  call's ``value`` is the class it goes to, if the text tells it, and ``root_*`` describe its root;
* ``def``: a variable's declaration or assignment: ``what`` local, field, param or unknown (an
  assignment to no local), ``role`` init, assign or none, ``id`` its value, ``value`` visibility;
* ``return``: ``id`` of the returned expression; ``cast``: ``name`` is the type, ``id`` its operand;
* ``block``: a class or method: ``line`` to ``end_line``, ``depth``, ``value`` its visibility, a method's
  ``type`` and ``args`` [parameters].

``cls`` and ``method`` name the enclosing class and method (``name/parameters``). Text that is no
source gives few rows and never an error; brackets that nothing closes end with the text.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|[-+*/%&|^!=<>]=|&&|\|\||\+\+|--|\S""", re.S)
NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")
# fixed values: words of the language
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default".split())
CONTROL = frozenset("if for while switch catch synchronized try".split())
RESTART = frozenset("else do finally try".split())
NO_NAME = frozenset("""if for while switch catch synchronized try else do finally return throw new case default break continue instanceof
    assert import package class interface enum extends implements throws this super null true false""".split())
PRIMITIVES = frozenset("boolean byte char short int long float double void".split())
OPEN_OF = {")": "([", "]": "([", "}": "{"}


class Frame:
    """An open bracket: what it holds, and the state of the expression in it."""

    def __init__(self, bracket: str, kind: str, below: Frame | None = None, inner: bool = False):
        self.bracket, self.kind, self.inner = bracket, kind, inner
        self.cls, self.method = (below.cls, below.method) if below else (None, None)
        self.depth = below.depth if below else 0
        # the nearest frame around this one that declares variables
        self.outer = below.outer if below and below.kind in ("args", "group", "index") else below
        self.call = None        # (what, name, scope) of the call whose arguments these are
        self.args: list = []    # finished arguments
        self.types: dict = {}   # variables declared here
        self.target = None      # what the statement's value goes to
        self.cast = None        # (type, place) of a cast whose operand follows
        self.more = None        # type and modifiers that further variables of the statement share
        self.block = None       # the row of a class or method
        self.start = kind in ("file", "class", "method", "block", "control")
        self.clear()

    def clear(self) -> None:
        self.operands, self.chain, self.other, self.dot = [], None, False, False


class Linear:
    def __init__(self, text: str):
        self.tokens, self.lines = [], []
        line, last = 0, 0
        for found in TOKEN.finditer(text):
            line += text.count("\n", last, found.start())
            last = found.start()
            token = found[0]
            if not token.startswith(("//", "/*")):
                self.tokens.append(token)
                self.lines.append(line)
        self.last_line = text.count("\n")
        self.closing = self._pairs()
        self.rows: list = []
        self.roots: list = []
        self.heads: list = []   # (what, name, value, type) of every expression
        self.stack = [Frame("{", "file")]
        self._run()

    def _pairs(self) -> dict:
        """The places of the brackets that close round and angle brackets; a statement's end or a
        brace leaves angle brackets open."""
        out, round_, angle = {}, [], []
        for i, token in enumerate(self.tokens):
            if token == "(":
                round_.append(i)
            elif token == "<":
                angle.append(i)
            elif token == ")" and round_:
                out[round_.pop()] = i
            elif token == ">" and angle:
                out[angle.pop()] = i
            elif token in ("{", "}", ";"):
                angle.clear()
        return out

    # ------------------------------------------------------------------ rows
    def _row(self, kind: str, at: int, **values) -> dict:
        top = self.stack[-1]
        row = {"kind": kind, "cls": top.cls, "method": top.method, "line": self.lines[min(at, len(self.lines) - 1)], "pos": len(self.rows), **values}
        self.rows.append(row)
        return row

    def _expr(self, at: int, what: str, name=None, value=None, scope=None, args=(), type=None) -> int:
        number = len(self.roots)
        own = scope is None or what == "name" and self._names_class(scope)  # a field of this or of a class begins a chain
        self.roots.append(number if own else self.roots[scope])
        self.heads.append((what, name, value, type))
        row = self._row("expr", at, id=number, what=what, name=name, value=value, scope=scope, root=self.roots[-1], args=list(args), type=type)
        if what == "call":
            row["value"] = self._receiver(scope)
            row["root_what"], row["root_name"], row["root_value"], row["root_type"] = self.heads[self.roots[-1]]
        return number

    def _names_class(self, scope: int) -> bool:
        what, name, value, type_ = self.heads[scope]
        return what == "name" and value is None and type_ is None and (name == "this" or name[:1].isupper())

    def _receiver(self, scope: int | None) -> str | None:
        """The class that a call goes to, where the text alone tells it."""
        if scope is None:
            return self.stack[-1].cls
        what, name, value, type_ = self.heads[scope]
        if self._names_class(scope):
            return self.stack[-1].cls if name == "this" else name
        return name if what == "new" else type_

    def _type_of(self, name: str):
        frame = self.stack[-1]
        while frame is not None and frame.kind != "class":
            if name in frame.types:
                return frame.types[name]
            frame = frame.outer
        return None

    # ------------------------------------------------------------------ expressions
    def _end_operand(self, frame: Frame) -> None:
        if frame.chain is not None:
            frame.operands.append(frame.chain)
            if frame.cast is not None:
                self._row("cast", frame.cast[1], what="cast", name=frame.cast[0], id=frame.chain)
                frame.cast = None
        frame.chain, frame.dot = None, False

    def _end_expr(self, frame: Frame, at: int):
        """The id of the frame's expression, or None if there is none."""
        self._end_operand(frame)
        ids, other = frame.operands, frame.other
        frame.clear()
        if not ids:
            return None
        if len(ids) == 1 and not other:
            return ids[0]
        return self._expr(at, "other" if other else "concat", args=ids)

    def _end_statement(self, frame: Frame, at: int) -> None:
        value = self._end_expr(frame, at)
        target, frame.target, frame.start = frame.target, None, True
        if target is None or value is None:
            return
        if target["kind"] == "return":
            self._row("return", at, id=value)
        else:
            self._row("def", at, id=value, **{k: v for k, v in target.items() if k != "kind"})

    def _close(self, bracket: str, at: int) -> None:
        wanted = OPEN_OF[bracket]
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].bracket in wanted:
                while len(self.stack) > k:
                    self._pop(at)
                return
            if bracket != "}" and self.stack[k].bracket == "{":
                return

    def _pop(self, at: int) -> None:
        frame = self.stack[-1]
        if frame.kind in ("args", "group", "index", "control"):
            value = self._end_expr(frame, at)
            if value is not None:
                frame.args.append(value)
        else:
            self._end_statement(frame, at)
        if frame.block is not None:
            frame.block["end_line"] = self.lines[at] if at < len(self.lines) else self.last_line
        self.stack.pop()
        below = self.stack[-1]
        if frame.kind == "args":
            what, name, scope = frame.call
            below.chain = self._expr(at, what, name=name, scope=scope, args=frame.args, value=None)
        elif frame.kind == "group":
            below.chain = frame.args[0] if frame.args else None
        elif frame.kind == "index":
            below.other = True
        elif frame.kind == "control":
            below.types.update(frame.types)  # a loop's variables stand in its body, which follows
            below.clear()
            below.start = True
        elif not frame.inner:
            below.clear()
            below.target, below.start = None, True

    # ------------------------------------------------------------------ declarations
    def _token(self, i: int) -> str:
        return self.tokens[i] if i < len(self.tokens) else ""

    def _skip(self, i: int) -> int:
        """The place behind the bracket that closes the one at ``i``, or ``i`` + 1."""
        return self.closing.get(i, i) + 1

    def _modifiers(self, i: int) -> tuple[int, set]:
        found = set()
        while True:
            token = self._token(i)
            if token == "@" and NAME.match(self._token(i + 1)) and self._token(i + 1) != "interface":
                i += 2
                while self._token(i) == ".":
                    i += 2
                if self._token(i) == "(":
                    i = self._skip(i)
            elif token in MODIFIERS and not (token == "synchronized" and self._token(i + 1) == "(") and not (token == "default" and self._token(i + 1) in (":", "->")):
                found.add(token)
                i += 1
            else:
                return i, found

    def _type(self, i: int) -> tuple[int, str | None]:
        """A type at ``i``: the place behind it and its text without type arguments."""
        if not NAME.match(self._token(i)) or self._token(i) in NO_NAME:
            return i, None
        text = self._token(i)
        i += 1
        while True:
            if self._token(i) == "." and NAME.match(self._token(i + 1)):
                text += "." + self._token(i + 1)
                i += 2
            elif self._token(i) == "<" and text not in PRIMITIVES:
                i = self._skip(i)
            elif self._token(i) == "[" and self._token(i + 1) == "]":
                text, i = text + "[]", i + 2
            else:
                return i, text

    def _visibility(self, found: set) -> str:
        return next((v for v in ("public", "protected", "private") if v in found), "default")

    def _declaration(self, i: int) -> int:
        """At a statement's start: open a class or method, note a variable; the place to go on from."""
        frame = self.stack[-1]
        at, (i, found) = i, self._modifiers(i)
        token = self._token(i)
        if token in ("class", "interface", "enum") or token == "@" and self._token(i + 1) == "interface":
            i += 2 if token == "@" else 1
            name = self._token(i)
            while i < len(self.tokens) and self._token(i) not in ("{", ";"):
                i += 1
            return self._open(i, "class", name, at, self._visibility(found)) if self._token(i) == "{" else i
        if frame.kind == "class" and token == "<":  # a method's own type parameters
            i = self._skip(i)
        if frame.kind == "class" and self._token(i + 1) == "(" and self._token(i) == frame.block["name"]:
            return self._method(i, at, found)
        after, type_ = self._type(i)
        if type_ is None or not NAME.match(self._token(after)) or self._token(after) in NO_NAME:
            return i if found else at
        name, then = self._token(after), self._token(after + 1)
        if then == "(" and frame.kind == "class":
            return self._method(after, at, found, type_)
        if then not in ("=", ";", ",", ":", ")", "["):
            return i if found else at
        return self._variable(after, at, type_, found)

    def _variable(self, i: int, at: int, type_: str, found: set) -> int:
        frame = self.stack[-1]
        name, i = self._token(i), i + 1
        while self._token(i) == "[" and self._token(i + 1) == "]":
            i += 2
        what = "field" if frame.kind == "class" else "local"
        if what == "local":
            frame.types[name] = type_
        target = {"what": what, "name": name, "type": type_, "value": self._visibility(found) if what == "field" else None}
        if self._token(i) == "=":
            frame.target = {"kind": "def", "role": "init", **target}
            frame.more = (type_, found)
            return i + 1
        self._row("def", at, id=None, role="none", **target)
        if self._token(i) == "," and NAME.match(self._token(i + 1)):
            return self._variable(i + 1, at, type_, found)
        return i + (self._token(i) == ":")

    def _method(self, i: int, at: int, found: set, returns: str | None = None) -> int:
        """A method or constructor whose name stands at ``i``."""
        name, end = self._token(i), self._skip(i + 1)
        params, k = [], i + 2
        while k < end - 1:
            k, _ = self._modifiers(k)
            after, type_ = self._type(k)
            dots = 3 if self.tokens[after:after + 3] == [".", ".", "."] else 0
            if type_ is None or not NAME.match(self._token(after + dots)):
                break
            params.append((self._token(after + dots), type_))
            k = after + dots + 1
            while k < end - 1 and self._token(k) != ",":
                k += 1
            k += 1
        while end < len(self.tokens) and self._token(end) not in ("{", ";", "}"):
            end += 1
        visibility = self._visibility(found)
        if self._token(end) != "{":
            return end + (self._token(end) == ";")
        out = self._open(end, "method", f"{name}/{len(params)}", at, visibility)
        frame = self.stack[-1]
        frame.block["args"], frame.block["type"] = [len(params)], returns
        for n, (param, type_) in enumerate(params):
            frame.types[param] = type_
            self._row("def", at, id=None, what="param", role="none", name=param, type=type_, value=visibility, args=[n])
        return out

    def _open(self, i: int, kind: str, name: str, at: int, visibility: str, inner: bool = False) -> int:
        below = self.stack[-1]
        frame = Frame("{", kind, below, inner)
        frame.block = self._row("block", at, what=kind, name=name, value=visibility, end_line=self.last_line, depth=below.depth)
        frame.depth += 1
        frame.cls, frame.method = (name, None) if kind == "class" else (frame.cls, name)
        self.stack.append(frame)
        return i + 1

    # ------------------------------------------------------------------ the pass
    def _run(self) -> None:
        i, n = 0, len(self.tokens)
        while i < n:
            frame = self.stack[-1]
            if frame.start:
                frame.start = False
                frame.more = None
                after = self._declaration(i)
                if self.stack[-1] is not frame or after != i:
                    i = after
                    continue
            i = self._step(i, frame)
        while len(self.stack) > 1:
            self._pop(n)
        self._end_statement(self.stack[0], n)

    def _step(self, i: int, frame: Frame) -> int:
        token, after = self.tokens[i], self._token(i + 1)
        if token in (")", "]", "}"):
            self._close(token, i)
        elif token == ";":
            while self.stack[-1].kind in ("args", "group", "index"):  # a bracket that the statement leaves open
                self._pop(i)
            self._end_statement(self.stack[-1], i)
        elif token == ",":
            self._comma(i, frame)
            if frame.more and frame.kind not in ("args", "group", "index") and NAME.match(after):
                type_, found = frame.more
                return self._variable(i + 1, i, type_, found)
        elif token == "{":
            self._brace(i, frame)
        elif token == "(":
            return self._paren(i, frame)
        elif token == "[":
            self.stack.append(Frame("[", "index", frame))
        elif token[0] == '"':
            frame.chain = self._expr(i, "literal", value=token[1:-1], type="String")
        elif token[0] == "'":
            frame.chain = self._expr(i, "literal", value=token[1:-1], type="char")
        elif token[0].isdigit():
            number = token.rstrip("lLfFdD_") if not token.startswith(("0x", "0X")) else token
            frame.chain = self._expr(i, "literal", value=number, type="double" if "." in token or token[-1] in "fFdD" else "int")
        elif token in ("true", "false", "null"):
            frame.chain = self._expr(i, "literal", value=token, type="null" if token == "null" else "boolean")
        elif token == ".":
            frame.dot = frame.chain is not None
        elif token == "+":
            if frame.chain is None:
                frame.other = True  # a sign
            self._end_operand(frame)
        elif token == "=":
            self._assign(i, frame)
        elif token == "->":
            frame.clear()
            frame.other = True
        elif token == "new":
            return self._creation(i, frame)
        elif token == "return":
            frame.target = {"kind": "return"}
        elif token in RESTART:
            frame.start = True
        elif token in CONTROL and after == "(":
            self.stack.append(Frame("(", "control", frame))
            return i + 2
        elif token in ("case", "default"):
            while i + 1 < len(self.tokens) and self._token(i) not in (":", "->", ";", "}"):
                i += 1
            frame.start = True
            return i + 1
        elif token in ("this", "super"):
            frame.chain = self._expr(i, "name", name=token)
        elif NAME.match(token) and token not in NO_NAME:
            self._word(i, frame)
            return i + 1 + (after == "(")
        else:  # any other operator: the operands stay known, the value does not
            self._end_operand(frame)
            frame.other = True
        return i + 1

    def _word(self, i: int, frame: Frame) -> None:
        token, scope = self.tokens[i], frame.chain if frame.dot else None
        if self._token(i + 1) == "(":
            opened = Frame("(", "args", frame)
            opened.call = ("call", token, scope)
            frame.dot = False
            self.stack.append(opened)
        elif scope is not None:
            head = self.heads[scope]
            frame.chain = self._expr(i, "name", name=token, value=head[1] if head[0] == "name" and not head[2] and not head[3] else "?", scope=scope)
        else:
            frame.chain = self._expr(i, "name", name=token, type=self._type_of(token))
        frame.dot = False

    def _creation(self, i: int, frame: Frame) -> int:
        after, type_ = self._type(i + 1)
        if type_ is None:
            return i + 1
        if self._token(after) == "(":
            opened = Frame("(", "args", frame)
            opened.call = ("new", type_, None)
            self.stack.append(opened)
            return after + 1
        frame.chain = self._expr(i, "other", name=type_)
        return after

    def _comma(self, i: int, frame: Frame) -> None:
        if frame.kind == "args":
            value = self._end_expr(frame, i)
            frame.args.append(value if value is not None else self._expr(i, "other"))
        elif frame.kind == "block" and frame.inner:
            self._end_expr(frame, i)
        else:
            target, more = frame.target, frame.more
            if target is not None:
                self._end_statement(frame, i)
                frame.start, frame.more = False, more
            else:
                self._end_expr(frame, i)

    def _assign(self, i: int, frame: Frame) -> None:
        """The value of what follows goes to the name before the sign."""
        chain, frame.operands = frame.chain, []
        frame.clear()
        if chain is None or self.heads[chain][0] != "name":
            return
        _, name, qualifier, _ = self.heads[chain]
        type_ = self._type_of(name) if not qualifier else None
        what = "local" if type_ else "unknown"
        if frame.target is None and frame.kind not in ("args", "group", "index"):
            frame.target = {"kind": "def", "what": what, "role": "assign", "name": name, "type": type_, "value": qualifier}

    def _brace(self, i: int, frame: Frame) -> None:
        if frame.chain is not None and self.heads[frame.chain][0] == "new":  # an anonymous class
            self._open(i, "class", self.heads[frame.chain][1], i, "private", inner=True)
            return
        inner = frame.kind in ("args", "group", "index") or frame.other or frame.target is not None
        self.stack.append(Frame("{", "block", frame, inner))

    def _paren(self, i: int, frame: Frame) -> int:
        after, type_ = self._type(i + 1)
        if type_ and self._token(after) == ")" and (type_[0].isupper() or type_.rstrip("[]") in PRIMITIVES):
            nxt = self._token(after + 1)
            if nxt == "(" or nxt[:1] in ('"', "'") or NAME.match(nxt) and (nxt not in NO_NAME or nxt in ("new", "this", "null", "true", "false")):
                frame.cast = (type_, i)
                return after + 1
        self.stack.append(Frame("(", "group", frame))
        return i + 1


def linearise(text: str | None) -> list[dict]:
    return Linear(text).rows if text else []
