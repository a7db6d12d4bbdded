"""Reading C without a compiler: tokens, brackets, declarations, statements and expressions of one file.

Reading never fails.  Branches of a conditional group (#if ... #endif) that hold whole statements or definitions are all
read, as nothing here evaluates conditions; branches that break one off are alternatives, of which the first that holds
anything counts.  A bracket that is not closed ends where it must: a brace before the next definition that starts in the
first column, others with the brace around them.  Nodes of expressions are tuples (kind, first token, token after the
last, parts ...).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

# Words of C and of the kernel's headers.
STORAGE = frozenset("static inline extern register typedef auto _Noreturn _Thread_local __inline __inline__".split())
QUALIFIERS = frozenset("const volatile restrict __restrict __restrict__ __const __volatile__ _Atomic __user __iomem __rcu __percpu __kernel".split())
TYPE_WORDS = frozenset("void char short int long float double signed unsigned _Bool bool __int128 __signed__".split())
TAGS = frozenset(("struct", "union", "enum"))
CONTROL = frozenset("if else while for do switch case default return goto break continue sizeof _Alignof alignof".split())
ATTRIBUTES = frozenset("static inline extern __init __exit __always_inline noinline asmlinkage __must_check __cold __user".split())
NOT_CALLED = CONTROL | TYPE_WORDS | {"defined", "typeof", "__typeof__", "__attribute__", "asm", "__asm__", "_Static_assert"}
_WITH_ARGUMENTS = frozenset("__attribute__ __declspec _Alignas alignas asm __asm__ __asm".split())
_TYPEOF = frozenset(("typeof", "__typeof__", "typeof_unqual"))
#: Words in two underscores that are types, not attributes.
_TYPE_NAME = re.compile(r"__(?:[us](?:8|16|32|64)|[lb]e(?:16|32|64)|kernel_\w+|builtin_va_list|wsum|sum16|poll_t)$")
_PLAIN = QUALIFIERS | TYPE_WORDS | STORAGE | _TYPEOF
_SPECIFIERS = STORAGE | QUALIFIERS | TYPE_WORDS
_BINARY = {op: level for level, ops in enumerate(("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %"), 3) for op in ops.split()}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
#: Expressions within expressions that are read.
DEEPEST = 100
#: Tokens of the top level that begin or end something there.
_STOPS = frozenset("{}([;")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = frozenset("()[]{}")

_TOKEN = re.compile(
    r"""\s*(?:(?P<token>[A-Za-z_]\w*+(?!")|[()\[\]{};,]|(?:u8|[LuU])?"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|\.?\d(?:[eEpP][+-]|[\w.])*
     |[A-Za-z_]\w*|<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|[<>=!]=|&&|\|\||/(?![/*])=?|[-+*%&|^]=|[^\s/\#\\])
    |//(?:[^\n\\]|\\.|\\\n)*|/\*.*?(?:\*/|\Z)
    |(?P<directive>\#(?:[^\n\\/"]|\\\n|\\.|"(?:\\.|[^"\\\n])*"?|/(?!\*)|/\*.*?(?:\*/|\Z))*)|\\)""",
    re.S | re.X,
)
#: The same with all that a match takes up first: matches follow one another, so their lengths tell where tokens are.
_WHOLE = re.compile(f"({_TOKEN.pattern})", _TOKEN.flags)
#: What can be a conditional group, in comments too.
_MAYBE_GROUP = re.compile(r"#\s*(?:if|el|endif)")
_DIRECTIVE = re.compile(r"#\s*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b")


@lru_cache(maxsize=1 << 14)  # asked of each token many times
def is_word(t: str) -> bool:
    return t[:1].isalpha() or t[:1] == "_"


@lru_cache(maxsize=1 << 14)
def is_attribute(t: str) -> bool:
    """A macro that stands for an attribute, such as __init or __maybe_unused."""
    if t in _PLAIN:
        return False
    return t in ATTRIBUTES or t == "notrace" or (t[:2] == "__" and t.lower() == t and not t.endswith("_t") and not _TYPE_NAME.match(t))


Token = tuple[str, int]


def _balanced(branch: list[Token]) -> bool:
    open_: list[str] = []
    for t, _ in branch:
        if t in _PAIRS:
            open_.append(_PAIRS[t])
        elif t in (")", "]", "}") and (not open_ or open_.pop() != t):
            return False
    return not open_


def _kept(before: str, branches: list[list[Token]]) -> list[Token]:
    """The tokens that a conditional group stands for."""
    there = [b for b in branches if b]
    ends = (";", "}", ",", ":", ")") if before in ("", ";", "{", "}") else (";", "}", ",", ":")
    if before in ("", ";", "{", "}", ",", ":", "(", ")") and all(b[-1][0] in ends and _balanced(b) for b in there):
        return [t for b in there for t in b]
    return there[0] if there else []


def tokens(text: str) -> list[Token]:
    """(token, offset) of a text, conditional groups resolved, other directives left out."""
    if "#" not in text or not _MAYBE_GROUP.search(text):
        found = _WHOLE.findall(text)
        return [(t, end - len(t)) for (_, t, _), end in zip(found, accumulate([len(whole) for whole, _, _ in found]), strict=True) if t]
    out: list[Token] = []
    groups: list[tuple[list[Token], list[list[Token]]]] = []  # (what stood before, branches done)

    def end() -> None:
        nonlocal out
        before, branches = groups.pop()
        branches.append(out)
        out = before
        out += _kept(out[-1][0] if out else "", branches)

    for m in _TOKEN.finditer(text):
        if m.lastindex == 1:  # a token
            out.append((m[1], m.start(1)))
        elif m["directive"] and (d := _DIRECTIVE.match(m["directive"])):
            if d[1].startswith("if"):
                groups.append((out, []))
                out = []
            elif groups and d[1] == "endif":
                end()
            elif groups:
                groups[-1][1].append(out)
                out = []
    while groups:
        end()
    return out


class Declarator(NamedTuple):
    """name; stars before it; arrays after it; first token and end of the parameters, or None; what a pair of brackets holds; the token after it."""

    name: str
    stars: str
    arrays: str
    params: tuple[int, int] | None
    inner: Declarator | None
    end: int

    @property
    def named(self) -> Declarator:
        return self.inner.named if self.inner else self

    @property
    def is_function(self) -> bool:
        return self.named.params is not None

    @property
    def is_function_pointer(self) -> bool:
        return self.inner is not None and self.params is not None and self.named.params is None and bool(self.named.stars)


class Declared(NamedTuple):
    """One declared name with the words of its type, whether it is a typedef, and the node that initialises it."""

    words: list[str]
    declarator: Declarator
    init: tuple | None


class Reader:
    """Tokens of a file with their brackets matched."""

    def __init__(self, text: str):
        self.text = text
        found = tokens(text)
        self.tok, self.at = [t for t, _ in found], [a for _, a in found]
        self.newlines = [m.start() for m in re.finditer("\n", text)]
        self.n, self.errors, self.depth = len(self.tok), [], 0
        self.close, self.after, self.unclosed = {}, {}, set()
        self.heads: dict[tuple[int, int], dict | None] = {}
        self._match()

    def line(self, k: int) -> int:
        """1-based line of a token; of the last one for the end of the file."""
        return bisect_right(self.newlines, self.at[min(k, self.n - 1)]) + 1

    def raw(self, lo: int, hi: int) -> str:
        """Source of tokens lo to hi, blanks as they are."""
        return self.text[self.at[lo] : self.at[hi - 1] + len(self.tok[hi - 1])] if hi > lo else ""

    def peek(self, k: int, hi: int | None = None) -> str:
        return self.tok[k] if k < (self.n if hi is None else hi) else ""

    # -- brackets -----------------------------------------------------------------------------------------------------
    def _match(self) -> None:
        stack: list[int] = []
        tok, first = self.tok, {0}.union(n + 1 for n in self.newlines)

        def shut(k: int, at: int, found: bool) -> None:
            self.close[k], self.after[k] = at, at + found

        braces = 0  # open ones
        for k in [k for k, (t, at) in enumerate(zip(tok, self.at, strict=True)) if t in _BRACKETS or at in first]:
            t = tok[k]
            if braces and self.at[k] in first and is_word(t) and any(tok[o] == "{" and not self._is_linkage(o) for o in stack) and self._starts_definition(k):
                kept = [o for o in stack if self._is_linkage(o)]
                lost = [o for o in stack if o not in kept]
                self.errors.append(f"unbalanced brace at line {self.line(next(o for o in lost if tok[o] == '{'))}")
                for o in lost:
                    shut(o, k, False)
                stack = kept
                braces = sum(tok[o] == "{" for o in stack)
            if t in _PAIRS:
                stack.append(k)
                braces += t == "{"
            elif t == "}":
                if not braces:
                    self.errors.append(f"unexpected brace at line {self.line(k)}")
                    continue
                while tok[o := stack.pop()] != "{":
                    shut(o, k, False)
                shut(o, k, True)
                braces -= 1
            elif t in (")", "]"):
                for at in range(len(stack) - 1, -1, -1):
                    if tok[stack[at]] == "{":
                        break
                    if _PAIRS[tok[stack[at]]] == t:
                        for o in stack[at + 1 :]:
                            shut(o, k, False)
                        shut(stack[at], k, True)
                        del stack[at:]
                        break
        lost = [o for o in stack if tok[o] == "{" and not self._is_linkage(o)]
        if lost:
            self.errors.append(f"unbalanced brace at line {self.line(lost[0])}")
        for o in stack:
            shut(o, self.n, False)
            self.unclosed.add(o)

    def _is_linkage(self, k: int) -> bool:
        return k >= 2 and self.tok[k - 2] == "extern" and self.tok[k - 1][0] == '"'

    def _starts_definition(self, k: int) -> bool:
        """Do the tokens from k on look like the head of a function or struct with a body?  Brackets are not matched yet."""
        if self.tok[k] in CONTROL or self.peek(k + 1) == ":":
            return False
        if self.tok[k] == "extern" and self.peek(k + 1)[:1] == '"':
            return self.peek(k + 2) == "{"
        depth, words, called, old = 0, 0, False, False  # old: declarations of parameters stand behind the brackets
        for j in range(k, min(k + 400, self.n)):
            t = self.tok[j]
            if t in ("(", "["):
                called |= not depth and is_word(self.tok[j - 1]) and (words > 1 or "DEFINE" in self.tok[k] or self.peek(j + 1) == "*")
                depth += 1
            elif t in (")", "]"):
                depth -= 1
                old |= not depth and called and is_word(self.peek(j + 1)) and not is_attribute(self.peek(j + 1))
            elif not depth:
                if t == "{":
                    return called or (words > 1 and self.tag_before(j) is not None)
                if (t == ";" and not old) or t in ("=", "}") or t in CONTROL:
                    return False
                words += is_word(t)
        return False

    def tag_before(self, brace: int) -> int | None:
        """The struct, union or enum word whose body a brace opens."""
        k = brace - 1
        while k >= 0 and (is_attribute(self.tok[k]) or self.tok[k] == ")"):
            if self.tok[k] == ")":
                depth = 0
                while k >= 0 and (depth := depth + (self.tok[k] == ")") - (self.tok[k] == "(")):
                    k -= 1
                k -= 1
                if k < 0 or not (self.tok[k] in _WITH_ARGUMENTS or is_attribute(self.tok[k])):
                    return None
            k -= 1
        if k >= 0 and self.tok[k] in TAGS:
            return k
        if k < 0 or not is_word(self.tok[k]):
            return None
        k -= 1
        while k >= 0 and (is_attribute(self.tok[k]) or self.tok[k] == ")"):
            if self.tok[k] == ")":
                while k >= 0 and self.tok[k] != "(" or self.peek(k - 1) == "(":
                    k -= 1
                k -= 1
            k -= 1
        return k if k >= 0 and self.tok[k] in TAGS else None

    def parts(self, lo: int, hi: int, sep: str) -> Iterator[tuple[int, int]]:
        """Ranges between separators outside all brackets."""
        k = start = lo
        while k < hi:
            t = self.tok[k]
            if t == sep:
                yield start, k
                start = k = k + 1
            else:
                k = min(self.after[k], hi) if t in _PAIRS else k + 1
        yield start, hi

    # -- declarations -------------------------------------------------------------------------------------------------
    def specifiers(self, k: int, hi: int) -> tuple[list[str], int, tuple[int, int] | None]:
        """(words of the type, where declarators begin, body of a struct or union among the words)."""
        words, body, tok = [], None, self.tok
        while k < hi:
            t, n = tok[k], tok[k + 1] if k + 1 < hi else ""
            if t in TAGS:
                words.append(t)
                k += 1
                while k < hi and (is_attribute(tok[k]) or tok[k] in _WITH_ARGUMENTS):
                    k = self.after[k + 1] if self.peek(k + 1, hi) == "(" else k + 1
                if k < hi and is_word(tok[k]):
                    words.append(tok[k])
                    k += 1
                while k < hi and (is_attribute(tok[k]) or tok[k] in _WITH_ARGUMENTS):
                    k = self.after[k + 1] if self.peek(k + 1, hi) == "(" else k + 1
                if self.peek(k, hi) == "{":
                    body = (k + 1, min(self.close[k], hi))
                    k = self.after[k]
            elif t in _WITH_ARGUMENTS and n == "(":
                k = self.after[k + 1]
            elif t in _TYPEOF and n == "(":
                words.append(re.sub(r"\s+", "", self.raw(k, min(self.after[k + 1], hi))))
                k = self.after[k + 1]
            elif t in _SPECIFIERS:
                words.append(t)
                k += 1
            elif is_word(t):
                typed = any(w not in STORAGE and w not in QUALIFIERS and not is_attribute(w) for w in words)
                if is_attribute(t) and (is_word(n) or n in ("*", "")):
                    words.append(t)
                    k += 1
                elif is_attribute(t) and n == "(" and is_word(self.peek(self.after[k + 1], hi)):
                    k = self.after[k + 1]
                elif is_word(n) and not is_attribute(n) and n not in _WITH_ARGUMENTS:
                    words.append(t)
                    k += 1
                elif is_word(n) and (not typed or (is_attribute(n) and is_word(self.peek(k + 2, hi)))):
                    words.append(t)
                    k += 1
                elif n == "*" or (n == "(" and self.peek(k + 2, hi) == "*" and not typed) or (not typed and n == ""):
                    words.append(t)
                    k += 1
                    if n == "(":
                        break
                else:
                    break
            else:
                break
        return words, k, body

    def declarator(self, k: int, hi: int) -> Declarator:
        stars = ""
        while k < hi and ((t := self.tok[k]) == "*" or t in QUALIFIERS or (is_attribute(t) and self.peek(k + 1, hi) != "(" and is_word(self.peek(k + 1, hi)))):
            if t == "*":
                stars += "*"
            elif not is_attribute(t):
                stars += f" {t} " if stars else ""
            k += 1
        name, inner, arrays, params = "", None, "", None
        if self.peek(k, hi) == "(" and (self.peek(k + 1, hi) in ("*", "(") or (is_word(self.peek(k + 1, hi)) and self.peek(k + 2, hi) in (")", "(", "["))):
            inner = self.declarator(k + 1, min(self.close[k], hi))
            k = self.after[k]
        elif k < hi and is_word(self.tok[k]) and self.tok[k] not in CONTROL:
            name = self.tok[k]
            k += 1
        while k < hi:
            if self.tok[k] == "[":
                arrays += re.sub(r"\s+", " ", self.raw(k, min(self.after[k], hi)))
                k = self.after[k]
            elif self.tok[k] == "(" and params is None:
                params = (k + 1, min(self.close[k], hi))
                k = self.after[k]
            elif self.tok[k] in _WITH_ARGUMENTS or is_attribute(self.tok[k]):
                k = self.after[k + 1] if self.peek(k + 1, hi) == "(" else k + 1
            else:
                break
        return Declarator(name, stars.strip(), arrays, params, inner, k)

    def type_text(self, words: list[str], d: Declarator) -> str:
        """The type of a declared name: pointers after the words, arrays after these; functions pointed to in brackets."""
        base = " ".join(w for w in words if w not in STORAGE and not is_attribute(w))
        if d.inner is not None and d.params is not None:
            pointers = d.named.stars + d.named.arrays
            return f"{self.pointed(base, d.stars)} ({pointers})({re.sub(r'\s+', ' ', self.raw(*d.params)).strip()})"
        return self.pointed(base, d.stars + (d.named.stars if d.inner else "")) + d.named.arrays

    @staticmethod
    def pointed(base: str, stars: str) -> str:
        return f"{base} {stars}" if stars else base

    def parameter(self, lo: int, hi: int) -> tuple[str, str]:
        """(name, type) of one parameter."""
        words, k, _ = self.specifiers(lo, hi)
        if not words and k >= hi or self.peek(k, hi) == "...":
            return "", re.sub(r"\s+", " ", self.raw(lo, hi))
        d = self.declarator(k, hi)
        if not words and d.name:
            return "", d.name
        return d.named.name, self.type_text(words, d)

    def parameters(self, span: tuple[int, int]) -> list[tuple[str, str]]:
        if span[1] <= span[0] or (span[1] - span[0] == 1 and self.tok[span[0]] == "void"):
            return []
        return [self.parameter(a, b) for a, b in self.parts(*span, ",") if b > a]

    def declared(self, lo: int, hi: int) -> tuple[list[Declared], int]:
        """What a declaration (without its semicolon) declares, and where reading stopped."""
        words, k, _ = self.specifiers(lo, hi)
        out = []
        while k < hi:
            d, init = self.declarator(k, hi), None
            k = d.end
            if self.peek(k, hi) == "=":
                init, k = self.expression(k + 1, hi, 1)
            elif self.peek(k, hi) == ":":
                _, k = self.expression(k + 1, hi, 2)
            if d.named.name:
                out.append(Declared(words, d, init))
            if self.peek(k, hi) != ",":
                break
            k += 1
        return out, k

    # -- the top level ------------------------------------------------------------------------------------------------
    def items(self, lo: int = 0, hi: int | None = None) -> Iterator[tuple[str, int, int, int]]:
        """(kind, first token, token of the body's brace, token after it all) of functions and declarations."""
        hi = self.n if hi is None else hi
        tok, k, start = self.tok, lo, lo
        while k < hi:
            t = tok[k]
            if t not in _STOPS:
                k += 1
            elif t == "{":
                if self._is_linkage(k):
                    yield from self.items(k + 1, min(self.close[k], hi))
                elif self.tag_before(k) is not None or any(self.tok[j] == "=" for j in self._outside(start, k)):
                    closed = self.after[k] > self.close[k]
                    k = self.after[k]
                    start = start if closed else k  # what goes on there is a definition of its own
                    continue
                else:
                    yield "function", start, k, self.after[k]
                start = k = self.after[k]
            elif t in ("(", "["):
                k = self.after[k]
            elif t == ";":
                if self._old_style(start, k, hi):
                    k += 1
                    continue
                yield "declaration", start, k, k + 1
                start = k = k + 1
            else:
                start = k = k + 1

    def _outside(self, lo: int, hi: int) -> Iterator[int]:
        k = lo
        while k < hi:
            yield k
            k = self.after[k] if self.tok[k] in _PAIRS else k + 1

    def _old_style(self, start: int, k: int, hi: int) -> bool:
        """Is the semicolon at k one of declarations of parameters, between the brackets of a function's head and its body?"""
        first = next((j for j in self._outside(start, k) if self.tok[j] == "("), None)
        if first is None or first == start or not is_word(self.tok[first - 1]):
            return False
        inside = [self.tok[j] for j in range(first + 1, self.close[first])]
        if not inside or any(not (is_word(t) if i % 2 == 0 else t == ",") for i, t in enumerate(inside)) or inside == ["void"]:
            return False
        j = self.after[first]
        if j >= k or not is_word(self.tok[j]) or is_attribute(self.tok[j]):
            return False
        while j < hi and self.tok[j] not in ("{", "}", "=", "("):
            j = self.after[j] if self.tok[j] == "[" else j + 1
        return j < hi and self.tok[j] == "{" and self.tok[j - 1] == ";"

    def function_head(self, lo: int, hi: int) -> dict | None:
        """name, return_type, params and attributes of a function from the tokens before its body, read once."""
        if (lo, hi) not in self.heads:
            self.heads[lo, hi] = self._function_head(lo, hi)
        return self.heads[lo, hi]

    def _function_head(self, lo: int, hi: int) -> dict | None:
        # A macro call without a semicolon before the head is no part of it.
        while lo + 1 < hi and is_word(self.tok[lo]) and self.tok[lo + 1] == "(" and self.after[lo + 1] < hi and is_word(self.tok[self.after[lo + 1]]) and self.tok[lo] not in _TYPEOF:
            follows = self.tok[self.after[lo + 1]]
            if is_attribute(follows) and self.tok[lo] not in _WITH_ARGUMENTS and self._last_word(lo, hi):
                break
            lo = self.after[lo + 1]
        if lo >= hi or self.tok[lo] in CONTROL:
            return None
        words, k, _ = self.specifiers(lo, hi)
        d = self.declarator(k, hi)
        f = d.named
        if not f.name or f.params is None or f.name in NOT_CALLED:
            return None
        attributes = [w for w in words if w in ATTRIBUTES or is_attribute(w)]
        typed = [w for w in words if w not in STORAGE and not is_attribute(w)]
        if d is not f:  # a function that returns a pointer to a function or an array
            returns = self.type_text(words, d._replace(inner=d.inner._replace(name="", params=None)) if d.inner is f else d)
        else:
            returns = self.pointed(" ".join(typed), d.stars)
        arguments = [re.sub(r"\s+", " ", self.raw(a, b)) for a, b in self.parts(*f.params, ",") if b > a]
        if not typed and f.name.upper() == f.name:  # a macro that makes the head
            if m := re.fullmatch(r"(COMPAT_)?SYSCALL_DEFINE[0-6]", f.name):
                pairs = zip(arguments[2::2], arguments[1::2], strict=False)
                return {"name": ("compat_" if m[1] else "") + "sys_" + (arguments or [""])[0], "return_type": "long", "params": list(pairs), "attributes": [*attributes, f.name], "first": lo, "span": (lo, lo)}
            if arguments and re.fullmatch(r"[A-Za-z_]\w*", arguments[0]):
                return {"name": arguments[0], "return_type": "", "params": [], "attributes": [*attributes, f.name], "first": lo, "span": (lo, lo)}
        params = self.parameters(f.params)
        if k < hi and f.end < hi and params and all(not n for n, _ in params):  # old style: names first, their types behind
            types = {x.declarator.named.name: self.type_text(x.words, x.declarator) for a, b in self.parts(d.end, hi, ";") if b > a for x in self.declared(a, b)[0]}
            params = [(t, types.get(t, "int")) for _, t in params] if types else params
        return {"name": f.name, "return_type": returns, "params": params, "attributes": attributes, "first": lo, "span": f.params}

    def _last_word(self, lo: int, hi: int) -> bool:
        """Is there no further pair of brackets outside others after the first one?"""
        return not any(self.tok[j] == "(" for j in self._outside(self.after[lo + 1], hi))

    # -- expressions --------------------------------------------------------------------------------------------------
    def is_type(self, lo: int, hi: int) -> bool:
        """Can lo to hi, as the content of brackets before an operand, be a type?"""
        if lo >= hi or not is_word(self.tok[lo]):
            return False
        if self.tok[lo] in TAGS or self.tok[lo] in TYPE_WORDS or self.tok[lo] in QUALIFIERS or self.tok[lo] in _TYPEOF:
            return True
        k = lo
        while k < hi and is_word(self.tok[k]):
            k += 1
        if k == hi:
            n = self.peek(hi + 1)
            return hi - lo > 1 or (is_word(n) and n not in CONTROL) or n[:1].isdigit() or n[:1] in ('"', "'", "{", "~", "!")
        return all(self.tok[j] == "*" or self.tok[j] in QUALIFIERS for j in range(k, hi))

    def expression(self, k: int, hi: int, least: int = 0) -> tuple[tuple, int]:
        """Node of the expression at k and the token after it; least 0 takes commas, 1 assignments, 2 conditions, more the levels of operators."""
        if self.depth > DEEPEST:  # the rest is kept as it stands
            return ("other", k, hi), hi
        self.depth += 1
        node = self._expression(k, hi, least)
        self.depth -= 1
        return node

    def _expression(self, k: int, hi: int, least: int) -> tuple[tuple, int]:
        lo = k
        left, k = self._unary(k, hi)
        while k < hi:
            t = self.tok[k]
            if t in _ASSIGN and least <= 1:
                right, k = self.expression(k + 1, hi, 1)
                left = ("assign", lo, k, t, left, right)
            elif t == "?" and least <= 2:
                yes, k = self.expression(k + 1, hi, 0) if self.peek(k + 1, hi) != ":" else (left, k + 1)
                no, k = self.expression(k + 1, hi, 2) if self.peek(k, hi) == ":" else (yes, k)
                left = ("cond", lo, k, left, yes, no)
            elif (level := _BINARY.get(t, 0)) and level >= least:
                sides = [left]
                while k < hi and _BINARY.get(self.tok[k]) == level:
                    right, k = self.expression(k + 1, hi, level + 1)
                    sides.append(right)
                left = ("binary", lo, k, sides)
            elif t == "," and not least:
                sides = [left]
                while self.peek(k, hi) == ",":
                    right, k = self.expression(k + 1, hi, 1)
                    sides.append(right)
                left = ("comma", lo, k, sides)
            else:
                break
        return left, k

    def _unary(self, k: int, hi: int) -> tuple[tuple, int]:
        lo, before = k, []
        while k < hi:
            t = self.tok[k]
            if t in ("&", "*", "-", "+", "!", "~", "++", "--", "&&"):
                before.append((t, k))
                k += 1
            elif t == "(" and self.is_type(k + 1, self.close[k]) and self.after[k] < hi and self.tok[self.after[k]] not in (")", ",", ";", "]"):
                before.append(("cast", k))
                k = self.after[k]
            elif t in ("__extension__", "__real__", "__imag__"):
                k += 1
            else:
                break
        node, k = self._postfix(k, hi)
        for op, at in reversed(before[-DEEPEST:]):
            node = ("cast", at, k, node) if op == "cast" else ("unary", at, k, op, node)
        return node, max(k, lo + 1)

    def _postfix(self, k: int, hi: int) -> tuple[tuple, int]:
        lo = k
        t = self.peek(k, hi)
        if t in ("sizeof", "_Alignof", "alignof", "__alignof__"):
            if self.peek(k + 1, hi) == "(":
                return ("other", lo, self.after[k + 1]), min(self.after[k + 1], hi)
            _, k = self._unary(k + 1, hi)
            return ("other", lo, k), k
        if t == "(":
            end = min(self.close[k], hi)
            if self.peek(k + 1, hi) == "{":
                node = ("block", lo, self.after[k], k + 1)
            else:
                node = self.expression(k + 1, end)[0] if end > k + 1 else ("other", lo, k + 1)
            k = min(self.after[k], hi)
        elif t == "{":
            node, k = ("list", lo, self.after[k], self._items(k + 1, min(self.close[k], hi))), min(self.after[k], hi)
        elif t and is_word(t):
            node, k = ("id", lo, lo + 1, t), k + 1
        elif t[:1] in ('"', "'") or t[:1].isdigit() or (t[:1] == "." and len(t) > 1 and t != "..."):
            k += 1
            while k < hi and (self.tok[k][0] == '"' or (is_word(self.tok[k]) and t[0] == '"' and self.peek(k + 1, hi)[:1] in ('"', ")", ","))):
                k += 1
            return ("literal", lo, k, self.raw(lo, k)), k
        else:
            return ("other", lo, min(lo + 1, hi)), min(lo + 1, hi)
        while k < hi:
            t = self.tok[k]
            if t == "(":
                node = ("call", lo, self.after[k], node, self.arguments(k))
                k = min(self.after[k], hi)
            elif t == "[":
                inner = self.expression(k + 1, self.close[k])[0] if self.close[k] > k + 1 else ("other", k, k + 1)
                node = ("index", lo, self.after[k], node, inner)
                k = min(self.after[k], hi)
            elif t in (".", "->") and is_word(self.peek(k + 1, hi)):
                node = ("member", lo, k + 2, node, t, self.tok[k + 1])
                k += 2
            elif t in ("++", "--"):
                k += 1
            else:
                break
        return node, k

    def arguments(self, k: int) -> list[tuple]:
        """Nodes of the arguments in the brackets at k; what is no expression (a type, say) is kept as it stands."""
        out = []
        for a, b in self.parts(k + 1, self.close[k], ","):
            if b > a:
                node, end = self.expression(a, b, 1) if self.tok[a] not in TAGS else (("other", a, b), b)
                out.append(node if end == b else ("other", a, b, node))
        return out

    def _items(self, lo: int, hi: int) -> list[tuple[str, tuple]]:
        """(designator, node) of the items of an initialiser: ".name", "[]" or ""."""
        out = []
        for a, b in self.parts(lo, hi, ","):
            name = ""
            while a < b and (self.tok[a] == "[" or (self.tok[a] == "." and is_word(self.peek(a + 1, b)))):
                name, a = ("[]", self.after[a]) if self.tok[a] == "[" else ("." + self.tok[a + 1], a + 2)
            if a < b and name and self.tok[a] == "=":
                a += 1
            elif a + 1 < b and is_word(self.tok[a]) and self.tok[a + 1] == ":":  # name: value
                name, a = "." + self.tok[a], a + 2
            if a < b:
                out.append((name, self.expression(a, b, 1)[0]))
        return out

    # -- statements ---------------------------------------------------------------------------------------------------
    def is_declaration(self, k: int, hi: int) -> bool:
        t, n = self.tok[k], self.peek(k + 1, hi)
        if t in STORAGE or t in QUALIFIERS or t in TYPE_WORDS or t in TAGS or (t in _TYPEOF and n == "("):
            return True
        if not is_word(t) or t in CONTROL:
            return False
        if is_word(n) and n not in CONTROL:
            return True
        j = k + 1
        while j < hi and (self.tok[j] == "*" or self.tok[j] in QUALIFIERS):
            j += 1
        return j > k + 1 and j < hi and is_word(self.tok[j]) and self.tok[j] not in CONTROL and self.peek(j + 1, hi) in ("=", ";", ",", "[", "")

    def statements(self, lo: int, hi: int) -> Iterator[tuple[str, int, object]]:
        """("declared", token, Declared), ("expression", token, node) and ("while", token, (condition or None, first token and end of the body)) of all statements, in order, those within others too."""
        k = lo
        while k < hi:
            t = self.tok[k]
            if t in ("{", "}", ";", ")", "]") or t in ("else", "do", "break", "continue"):
                k += 1
            elif t in ("if", "switch", "while", "for") and self.peek(k + 1, hi) == "(":
                end = min(self.close[k + 1], hi)
                if t == "for":
                    clauses = [*self.parts(k + 2, end, ";")]
                    for a, b in clauses:
                        yield from self.simple(a, b)
                    if len(clauses) == 3 and clauses[1][0] == clauses[1][1]:
                        yield "while", k, (None, (self.after[k + 1], self.extent(self.after[k + 1], hi)))
                elif end > k + 2:
                    node = self.expression(k + 2, end)[0]
                    yield "expression", k, node
                    if t == "while":
                        yield "while", k, (node, (self.after[k + 1], self.extent(self.after[k + 1], hi)))
                k = self.after[k + 1]
            elif t in ("asm", "__asm__") or t == "goto":
                while k < hi and self.tok[k] != ";":
                    k = self.after[k] if self.tok[k] == "(" else k + 1
            elif t == "case":
                _, k = self.expression(k + 1, hi, 2)
                k += self.peek(k, hi) == ":"
            elif is_word(t) and self.peek(k + 1, hi) == ":" and t not in ("return",):
                k += 2
            else:
                k = yield from self._one(k + (t == "return"), hi)

    def _one(self, k: int, hi: int) -> Iterator[tuple[str, int, object]]:
        """The declaration or expression at k; returns the token after it."""
        if k >= hi or self.tok[k] == ";":
            return k + 1
        if self.is_declaration(k, hi):
            end = next(b for _, b in self.parts(k, hi, ";"))
            stop = end
            for x in (found := self.declared(k, end))[0]:
                yield "declared", k, x
            stop = max(found[1], k + 1)
            return stop if stop < end else end + 1
        node, end = self.expression(k, hi)
        yield "expression", k, node
        return max(end, k + 1)

    def simple(self, lo: int, hi: int) -> Iterator[tuple[str, int, object]]:
        """One declaration or expression without its end, such as a part of a for."""
        if lo < hi:
            yield from self._one(lo, hi)

    def extent(self, k: int, hi: int) -> int:
        """The token after the one statement at k."""
        while k < hi:
            t = self.tok[k]
            if t == "{":
                return min(self.after[k], hi)
            if t in ("if", "while", "for", "switch") and self.peek(k + 1, hi) == "(":
                body = self.extent(self.after[k + 1], hi)
                if t != "if" or self.peek(body, hi) != "else":
                    return body
                k = body + 1
            elif t == "do":
                k = self.extent(k + 1, hi)
            elif t == ";":
                return k + 1
            else:
                k = self.after[k] if t in _PAIRS else k + 1
        return hi


def walk(node: tuple) -> Iterator[tuple]:
    """A node and all below it, from left to right."""
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        kind = at[0]
        if kind in ("id", "literal"):
            continue
        if kind == "call":
            stack.extend(reversed(at[4]))
            stack.append(at[3])
        elif kind in ("member", "cast"):
            stack.append(at[3])
        elif kind == "unary":
            stack.append(at[4])
        elif kind in ("index", "assign", "cond"):
            stack.extend(reversed(at[4:6] if kind == "assign" else at[3:5] if kind == "index" else at[3:6]))
        elif kind in ("binary", "comma"):
            stack.extend(reversed(at[3]))
        elif kind == "list":
            stack.extend(x for _, x in reversed(at[3]))
        elif kind == "other" and len(at) > 3:
            stack.append(at[3])
