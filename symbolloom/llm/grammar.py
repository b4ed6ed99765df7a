"""Patterns over token kinds, matched exactly, or with fewest edits by a chart of items per position and cost.

A pattern is written once, in the common subset of regular expressions. For exact matching it is compiled
as such. For repair it becomes a position automaton: the chart keeps, for every input position, the grammar
positions (items) by the fewest edits with which they can be reached, as bits of one integer for each number
of edits. Numbers without items take no room, so edits need no bound. An edit deletes, inserts or replaces
one token.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from re import _constants as C  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

import numpy as np

from symbolloom.llm.brackets import pair


def _bits(items: int) -> list[int]:
    out = []
    while items:
        low = items & -items
        out.append(low.bit_length() - 1)
        items ^= low
    return out


class Chart:
    """Error-correcting recognition of one pattern."""

    def __init__(self, pattern: str) -> None:
        self._sets: list[frozenset[int]] = []
        self._follow: list[int] = []
        self.first, self.last, self.empty = self._build(_parser.parse(pattern))
        self._merge()
        self._by_char: dict[str, int] = {}
        self._next: dict[int, int] = {}
        self._bytes: dict[tuple[int, int], int] = {}

    def _build(self, node) -> tuple[int, int, bool]:
        first, last, empty = 0, 0, True
        for op, arg in node:
            f, l, e = self._one(op, arg)  # noqa: E741
            self._link(last, f)
            first |= f if empty else 0
            last = l | (last if e else 0)
            empty = empty and e
        return first, last, empty

    def _merge(self) -> None:
        """Makes positions one that match the same tokens and go on alike (the coarsest such partition, by refinement)."""
        members: dict[int, int] = {}
        which = [members.setdefault(f, len(members)) for f in self._follow]
        after = [_bits(f) for f in members]
        seen: dict = {}
        start = [seen.setdefault((tokens, self.last >> i & 1), len(seen)) for i, tokens in enumerate(self._sets)]
        classes, n = start, 0
        while len(seen) != n:
            n, bit = len(seen), [1 << c for c in classes]
            marks = []
            for follow in after:
                mark = 0
                for p in follow:
                    mark |= bit[p]
                marks.append(mark)
            seen = {}
            classes = [seen.setdefault((c, marks[w]), len(seen)) for c, w in zip(start, which, strict=True)]
        image = lambda items: sum(1 << c for c in {classes[p] for p in _bits(items)})
        one = {c: p for p, c in enumerate(classes)}
        self._sets, self._follow = [self._sets[one[c]] for c in range(len(one))], [image(self._follow[one[c]]) for c in range(len(one))]
        self.first, self.last = image(self.first), image(self.last)

    def _link(self, last: int, first: int) -> None:
        while last:
            low = last & -last
            self._follow[low.bit_length() - 1] |= first
            last ^= low

    def _one(self, op, arg) -> tuple[int, int, bool]:
        if op in (C.LITERAL, C.IN):
            if op is C.LITERAL:
                chars = {arg}
            else:
                chars = set()
                for o, a in arg:
                    chars |= {a} if o is C.LITERAL else set(range(a[0], a[1] + 1))
            bit = 1 << len(self._sets)
            self._sets.append(frozenset(chars))
            self._follow.append(0)
            return bit, bit, False
        if op in (C.SUBPATTERN, C.ATOMIC_GROUP):
            return self._build(arg[3] if op is C.SUBPATTERN else arg)
        if op is C.BRANCH:
            parts = [self._build(b) for b in arg[1]]
            first = last = 0
            for f, l, _ in parts:  # noqa: E741
                first, last = first | f, last | l
            return first, last, any(e for *_, e in parts)
        if op in (C.MAX_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            first, last, empty = self._build(inner)
            if high > 1:
                self._link(last, first)
            return first, last, empty or low == 0
        raise ValueError(f"not in the subset: {op}")

    def _after(self, items: int) -> int:
        """All items that can come next after some of ``items``: a union over bytes of the set, each remembered."""
        got = self._next.get(items)
        if got is None:
            got = 0
            for at, byte in enumerate(items.to_bytes((items.bit_length() + 7) // 8, "little")):
                if byte:
                    part = self._bytes.get((at, byte))
                    if part is None:
                        part = 0
                        for k in range(8):
                            if byte >> k & 1 and 8 * at + k < len(self._follow):
                                part |= self._follow[8 * at + k]
                        self._bytes[at, byte] = part
                    got |= part
            if len(self._next) < 50_000:
                self._next[items] = got
        return got

    def _on(self, char: str) -> int:
        got = self._by_char.get(char)
        if got is None:
            code = ord(char)
            got = self._by_char[char] = sum(1 << i for i, s in enumerate(self._sets) if code in s)
        return got

    def cost(self, text: str, most: int | None = None) -> tuple[int, int] | None:
        """(fewest edits, position at which no exact parse goes on), or None for more than ``most`` edits."""
        start = 1 << len(self._sets)  # an item before everything
        step = lambda items: (self._after(items & ~start) | self.first) if items & start else self._after(items)
        rows, dead = self._inserted({0: start}, step, most), len(text)
        for i, char in enumerate(text):
            on, new = self._on(char), {}
            for k, items in rows.items():
                ahead = step(items)
                if now := ahead & on:
                    new[k] = new.get(k, 0) | now
                new[k + 1] = new.get(k + 1, 0) | items | ahead  # delete, replace
            if dead == len(text) and 0 not in new:
                dead = i
            rows = self._inserted(new, step, most)
            if not rows:
                return None
        for k, items in rows.items():
            if items & self.last or (self.empty and items & start):
                return k, dead
        return None

    @staticmethod
    def _inserted(found: dict[int, int], step, most: int | None) -> dict[int, int]:
        """Items by their fewest edits, in order, with those that inserting tokens leads to."""
        out, seen, waiting = {}, 0, sorted(found, reverse=True)
        while waiting:
            k = waiting.pop()
            if most is not None and k > most:
                break
            if items := found[k] & ~seen:
                out[k] = items
                seen |= items
                if ahead := step(items) & ~seen:
                    if k + 1 not in found:
                        waiting.append(k + 1)
                    found[k + 1] = found.get(k + 1, 0) | ahead
        return out


class _Content:
    """What stands in a bracket: its text, the edits it takes, what stands for it outside, and where that is."""

    def __init__(self, bracket: str, begin: int) -> None:
        self.bracket, self.begin = bracket, begin
        self.text, self.edits, self.shown = "", 0, ""
        self.around: _Content | None = None
        self.at, self.gone = 0, False

    def place(self) -> tuple[_Content, int]:
        """(the content around it, position there), past brackets that are gone and whose texts stand in those around them."""
        while self.around.gone:
            self.around, self.at = self.around.around, self.around.at + self.at
        return self.around, self.at


class Language:
    """Bracketed text: the content of each bracket pair is matched by itself and stands as one symbol outside.

    Subclasses give the roles that a content can play; the symbol tells which. A content that plays none is
    repaired by the cheapest role's chart, and counts as playing all.
    """

    #: opening bracket -> (first symbol, roles in order of their bits)
    brackets: dict[str, tuple[int, tuple[str, ...]]]
    patterns: dict[str, str]
    top: str
    MEMO_LENGTH = 1000

    CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">", "\u00ab": "\u00bb"}

    def __init__(self) -> None:
        self.exact = {k: re.compile(p) for k, p in self.patterns.items()}
        self.closers = {self.CLOSING[b]: b for b in self.brackets}
        free = "[^" + "".join(re.escape(c) for c in [*self.brackets, *self.closers]) + "]*"
        self.group = re.compile("|".join(f"{re.escape(b)}{free}{re.escape(c)}" for c, b in self.closers.items()))
        self.memo: dict[str, str] = {}
        self.bad: list[str] = []

    @classmethod
    def symbols(cls, bracket: str, role: str) -> str:
        """A character class of the symbols of contents that can play ``role``."""
        base, roles = cls.brackets[bracket]
        bit = 1 << roles.index(role)
        return "[" + "".join(chr(base + m) for m in range(1, 1 << len(roles)) if m & bit) + "]"

    def prepare(self, content: str, role: str) -> str:
        return content

    def kept(self, content: str, role: str) -> Sequence[int]:
        """The positions of ``content`` that ``prepare`` keeps."""
        return range(len(content))

    def misfits(self, content: str, role: str) -> list[int]:
        """Positions of tokens that break a rule of the role which its pattern doesn't hold; each is one edit."""
        return []

    @lru_cache(maxsize=None)  # noqa: B019  one instance per language and process
    def chart(self, role: str) -> Chart:
        return Chart(self.patterns[role])

    def role_mask(self, bracket: str, content: str) -> int:
        return sum(1 << i for i, r in enumerate(self.brackets[bracket][1]) if self.exact[r].fullmatch(self.prepare(content, r)))

    def _symbol(self, text: str) -> str:
        """The symbol of a bracketed span; '' if its content plays no role."""
        got = self.memo.get(text)
        if got is None:
            base, roles = self.brackets[text[0]]
            mask = self.role_mask(text[0], text[1:-1])
            got = chr(base + mask) if mask else ""
            if len(self.memo) > 100_000:
                self.memo.clear()
            if len(text) <= self.MEMO_LENGTH:
                self.memo[text] = got
        return got

    def _fold(self, m: re.Match) -> str:
        got = self._symbol(m[0])
        if not got:
            self.bad.append(m[0])
            base, roles = self.brackets[m[0][0]]
            return chr(base + (1 << len(roles)) - 1)
        return got

    def _fold_deep(self, kinds: str) -> str | None:
        """All spans folded in one pass, however deep they are; None if one plays no role or brackets don't match."""
        stack: list[list[str]] = [[]]
        for c in kinds:
            if c in self.brackets:
                stack.append([c])
            elif c in self.closers:
                if stack[-1][:1] != [self.closers[c]] or len(stack) < 2:
                    return None
                got = self._symbol("".join(stack.pop()) + c)
                if not got:
                    return None
                stack[-1].append(got)
            else:
                stack[-1].append(c)
        return "".join(stack[0]) if len(stack) == 1 else None

    #: Passes that fold innermost spans before the rest, which is deeper, is folded in one.
    PASSES = 32

    def accepts(self, kinds: str) -> bool:
        """Whether the chart has a parse without edits."""
        self.bad.clear()
        for _ in range(self.PASSES):
            kinds, n = self.group.subn(self._fold, kinds)
            if self.bad:
                return False
            if not n:
                break
        else:
            kinds = self._fold_deep(kinds)
            if kinds is None:
                return False
        return self.exact[self.top].fullmatch(self.prepare(kinds, self.top)) is not None

    def repair(self, kinds: str) -> tuple[int, list[int], bool]:
        """(edits, positions of edits, whether brackets are still open at the end) of the cheapest repair found.

        Brackets are paired greedily, and with the fewest edits of brackets; an opening one without a partner is
        closed where what is around it ends, or dropped. Of each pairing every content is repaired with the fewest
        edits by its cheapest role, and the cheapest pairing counts. As contents don't choose the pairing, nor
        do roles look outside, the sum is an upper bound where more than one token is wrong.
        """
        self.spans: dict[tuple[str, str], tuple[int, int, int]] = {}
        plan = self._pair_greedily(kinds)
        best = self._apply(kinds, plan)
        if best[0] > 1 and (other := self._pair_with_fewest(kinds)) != plan:
            got = self._apply(kinds, other)
            plan, best = (other, got) if got[0] < best[0] else (plan, best)
        lone = [i for i, p in plan.items() if p is None]
        if best[0] > 1 and lone and (dropped := self._better_dropped(kinds, plan, lone)):
            best = self._apply(kinds, plan | dict.fromkeys(dropped, -1))
        return best

    def _better_dropped(self, kinds: str, plan: dict[int, int | None], lone: list[int]) -> list[int]:
        """Those of the opening brackets without a partner that are cheaper dropped than closed, tried one after another.

        A trial puts the content into the one around it, and looks at those farther out only while they change.
        """
        spans: dict[int, _Content] = {}
        self._apply(kinds, plan, spans)
        out = []
        for i in lone:
            inner = spans[i]
            around, at = inner.place()
            changes, edits, text = [], -inner.edits, around.text[:at] + inner.text
            while True:
                got = self._content(around.bracket, text, around.bracket != "" and plan[around.begin] is None)
                edits += got[0] - around.edits
                changes.append((around, text, got))
                if around.bracket == "" or got[1] == around.shown:
                    break
                wider, begin = around.place()
                text = wider.text[:begin] + got[1] + wider.text[begin + len(around.shown) :]
                around = wider
            if edits < 0:
                out.append(i)
                inner.around, inner.at, inner.gone = changes[0][0], at, True
                for content, text, (content.edits, content.shown) in changes:
                    content.text = text
        return out

    def _content(self, bracket: str, text: str, inserted: bool) -> tuple[int, str]:
        """(edits, what stands for it outside) of one content, as _apply has them."""
        if not bracket:
            return self._span("", text)[0], ""
        n = len(text.rstrip("\n")) if inserted else len(text)
        key = bracket, text[:n]
        if key not in self.spans:
            self.spans[key] = self._span(*key)
        cost, _, mask = self.spans[key]
        return cost, chr(self.brackets[bracket][0] + mask) + text[n:]

    def _pair_greedily(self, kinds: str) -> dict[int, int | None]:
        """For each bracket: its partner, -1 to drop it, or None for an opening one that is closed where what is around it ends."""
        plan: dict[int, int | None] = {}
        stack: list[int] = []
        held = dict.fromkeys(self.brackets, 0)
        for i, c in enumerate(kinds):
            if c in self.brackets:
                plan[i] = None
                stack.append(i)
                held[c] += 1
            elif c in self.closers:
                plan[i] = -1
                if held[self.closers[c]]:
                    while kinds[stack[-1]] != self.closers[c]:
                        held[kinds[stack.pop()]] -= 1
                    at = stack.pop()
                    held[kinds[at]] -= 1
                    plan[i], plan[at] = at, i
        return plan

    def _pair_with_fewest(self, kinds: str) -> dict[int, int | None]:
        """As _pair_greedily, by the fewest edits of brackets. A replaced bracket has its partner's kind."""
        plan: dict[int, int | None] = {}
        left: list[int] = []
        for i, c in enumerate(kinds):
            if c in self.closers and left and kinds[left[-1]] == self.closers[c]:
                plan[i], plan[left[-1]] = left[-1], i
                left.pop()
            elif c in self.brackets or c in self.closers:
                left.append(i)
        opens = np.array([kinds[i] in self.brackets for i in left], bool)
        kind = np.array([ord(self.closers.get(kinds[i], kinds[i])) for i in left], np.int32)
        for a, k in pair(opens, kind):
            if k < 0:
                plan[left[a]] = None if opens[a] else -1
            else:
                plan[left[a]], plan[left[k]] = left[k], left[a]
        return plan

    def _apply(self, kinds: str, plan: dict[int, int | None], contents: dict[int, _Content] | None = None) -> tuple[int, list[int], bool]:
        """The repair by one pairing. ``contents`` gets the content of each bracket, by its position, and at -1 the outermost."""
        stack: list[tuple[str, int, list[str], list[int]]] = [("", -1, [], [])]
        edits, places = 0, []
        if contents is not None:
            contents[-1] = _Content("", -1)

        def close(inserted: bool = True) -> None:
            nonlocal edits
            bracket, at, content, index = stack.pop()
            n = len(content)
            while inserted and n and content[n - 1] == "\n":
                n -= 1  # what is missing stands at the end of a line
            key = bracket, "".join(content[:n])
            if key not in self.spans:
                self.spans[key] = self._span(*key)
            cost, where, mask = self.spans[key]
            edits += cost
            if cost:
                places.append(index[where] if where < n else (index[n - 1] + 1 if n else at))
            shown = [chr(self.brackets[bracket][0] + mask), *content[n:]]
            if contents is not None:
                got = contents[at]
                got.text, got.edits, got.shown = "".join(content), cost, "".join(shown)
                got.around, got.at = contents[stack[-1][1]], len(stack[-1][2])
            stack[-1][2].extend(shown)
            stack[-1][3].extend([at, *index[n:]])

        def edit(at: int) -> None:
            nonlocal edits
            edits += 1
            places.append(at)

        for i, c in enumerate(kinds):
            if i not in plan:
                stack[-1][2].append(c)
                stack[-1][3].append(i)
                continue
            partner = plan[i]
            if partner == -1:
                edit(i)
            elif partner is None or partner > i:
                if c not in self.brackets:
                    edit(i)
                    c = kinds[partner] if kinds[partner] in self.brackets else self.closers[kinds[partner]]
                stack.append((c, i, [], []))
                if contents is not None:
                    contents[i] = _Content(c, i)
            else:
                while stack[-1][1] != partner:
                    edit(i)
                    close()
                if c not in self.closers or stack[-1][0] != self.closers[c]:
                    edit(i)
                close(False)
        still_open = len(stack) > 1
        while len(stack) > 1:
            edit(len(kinds))
            close()
        text = "".join(stack[0][2])
        cost, where, _ = self._span("", text)
        if contents is not None:
            contents[-1].text, contents[-1].edits = text, cost
        if cost:
            edits += cost
            index = stack[0][3]
            places.append(index[where] if where < len(index) else len(kinds))
        return edits, sorted(places), still_open

    def _span(self, bracket: str, content: str) -> tuple[int, int, int]:
        """(edits, where, role mask) of one content."""
        if not bracket:
            if self.exact[self.top].fullmatch(self.prepare(content, self.top)):
                return 0, 0, 0
            return *self._least(content, (self.top,)), 0
        mask = self.role_mask(bracket, content)
        roles = self.brackets[bracket][1]
        return (0, 0, mask) if mask else (*self._least(content, roles), (1 << len(roles)) - 1)

    def _least(self, content: str, roles: tuple[str, ...]) -> tuple[int, int]:
        """(fewest edits, where) that make the content play one of the roles."""
        best = None
        for role in roles:
            misfits = self.misfits(content, role)
            got = self.chart(role).cost(self.prepare(content, role), best[0] - 1 - len(misfits) if best else None)
            if got:
                kept = self.kept(content, role)
                at = kept[got[1]] if got[0] and got[1] < len(kept) else len(content)
                best = got[0] + len(misfits), min([at, *misfits])
        assert best is not None
        return best
