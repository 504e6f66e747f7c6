"""Memoised parsing with derivatives over token streams.

A grammar is a set of EBNF rules.  The derivative of a language by a token is
what may follow that token; a text is read by taking derivatives one after the
other.  An empty derivative marks the failing token; an end whose language
does not hold the empty sentence marks a truncated text.

Languages are hash-consed nodes, sequences lean to the right, and derivatives
are memoised by (node, token).  What remains to be read is the same node
whenever the parser is in the same place of the same constructs, so after a few
files nearly every step is one look-up, as in an automaton that is built on
demand.  The memo is cleared when it gets too large, which costs time only.
"""

from __future__ import annotations

import re

EMPTY, NULL = 0, 1
_TERM, _SEQ, _ALT, _RULE, _STAR = range(5)

#: Nodes after which the memo starts anew.
MOST_NODES = 1_500_000
_LEX = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[=;|()\[\]{}]))")


class Grammar:
    """rules: ``name = body ;`` with 'terminals', TERMINALS, rules, ``|``, ``[optional]``, ``{repeated}`` and ``(groups)``."""

    def __init__(self, rules: str, start: str):
        self.tokens: dict[str, int] = {}
        self._bodies = self._read(rules)
        self._start_name = start
        self.width = len(self.tokens)
        self._clear()

    # -- reading rules --

    def _read(self, text: str) -> dict[str, tuple]:
        words: list[str] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 40]!r}")
            words.append(m.group().strip())
            at = m.end()
        words.append("")
        i = 0

        def alternatives() -> tuple:
            nonlocal i
            out = [sequence()]
            while words[i] == "|":
                i += 1
                out.append(sequence())
            return out[0] if len(out) == 1 else ("alt", *out)

        def sequence() -> tuple:
            nonlocal i
            out = []
            while words[i] not in ("|", ";", ")", "]", "}", ""):
                w = words[i]
                i += 1
                if w in ("(", "[", "{"):
                    inner = alternatives()
                    if words[i] != {"(": ")", "[": "]", "{": "}"}[w]:
                        raise ValueError(f"grammar: {w} not closed before {words[i]!r}")
                    i += 1
                    out.append(inner if w == "(" else ("opt", inner) if w == "[" else ("star", inner))
                elif w[0] == "'" or w.isupper():
                    out.append(("term", self.tokens.setdefault(w.strip("'"), len(self.tokens))))
                else:
                    out.append(("rule", w))
            return ("seq", *out)

        bodies = {}
        while words[i]:
            name = words[i]
            if words[i + 1] != "=" or name in bodies:
                raise ValueError(f"grammar: rule {name!r}")
            i += 2
            bodies[name] = alternatives()
            if words[i] != ";":
                raise ValueError(f"grammar: {name!r} ends at {words[i]!r}")
            i += 1
        return bodies

    # -- nodes --

    def _clear(self) -> None:
        self._nodes: list[tuple] = [(), ()]
        self._number: dict[tuple, int] = {}
        self._nullable: list[bool] = [False, True]
        self._memo: dict[int, int] = {}
        self.step = self._memo.get
        names = list(self._bodies)
        self._rule_nodes = {n: self._make((_RULE, k)) for k, n in enumerate(names)}
        self._rule_bodies: list[int] = [EMPTY] * len(names)
        # a rule is nullable if its body is: the least fixed point
        nullable = dict.fromkeys(names, False)

        def empty(e: tuple) -> bool:
            kind = e[0]
            if kind == "seq":
                return all(map(empty, e[1:]))
            if kind == "alt":
                return any(map(empty, e[1:]))
            return kind in ("opt", "star") or (kind == "rule" and nullable[e[1]])

        changed = True
        while changed:
            changed = False
            for n, body in self._bodies.items():
                if not nullable[n] and empty(body):
                    nullable[n] = changed = True
        for n in names:
            self._nullable[self._rule_nodes[n]] = nullable[n]
        for k, n in enumerate(names):
            self._rule_bodies[k] = self._build(self._bodies[n])
        self.start = self._rule_nodes[self._start_name]

    def _make(self, key: tuple) -> int:
        node = self._number.get(key)
        if node is None:
            node = self._number[key] = len(self._nodes)
            self._nodes.append(key)
            kind = key[0]
            self._nullable.append(
                kind == _STAR
                or (kind == _SEQ and self._nullable[key[1]] and self._nullable[key[2]])
                or (kind == _ALT and any(self._nullable[x] for x in key[1]))
            )
        return node

    def _seq(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == NULL:
            return b
        if b == NULL:
            return a
        heads = []
        while (key := self._nodes[a])[0] == _SEQ:
            heads.append(key[1])
            a = key[2]
        node = self._make((_SEQ, a, b))
        for head in reversed(heads):
            node = self._make((_SEQ, head, node))
        return node

    def _alt(self, parts: list[int]) -> int:
        flat: set[int] = set()
        for p in parts:
            if p != EMPTY:
                if p != NULL and self._nodes[p][0] == _ALT:
                    flat |= self._nodes[p][1]
                else:
                    flat.add(p)
        if len(flat) < 2:
            return next(iter(flat), EMPTY)
        # a·x | a·y is a·(x | y): what is open at the same place of several readings is read once
        tails: dict[int, list[int]] = {}
        for p in flat:
            key = self._nodes[p]
            if key and key[0] == _SEQ:
                tails.setdefault(key[1], []).append(p)
        for head, same in tails.items():
            if len(same) > 1:
                flat.difference_update(same)
                flat.add(self._make((_SEQ, head, self._alt([self._nodes[p][2] for p in same]))))
        if len(flat) < 2:
            return next(iter(flat))
        return self._make((_ALT, frozenset(flat)))

    def _build(self, e: tuple) -> int:
        kind = e[0]
        if kind == "term":
            return self._make((_TERM, e[1]))
        if kind == "rule":
            return self._rule_nodes[e[1]]
        if kind == "alt":
            return self._alt([self._build(x) for x in e[1:]])
        if kind == "opt":
            return self._alt([NULL, self._build(e[1])])
        if kind == "star":
            return self._make((_STAR, self._build(e[1])))
        node = NULL
        for x in reversed(e[1:]):
            node = self._seq(self._build(x), node)
        return node

    def nullable(self, node: int) -> bool:
        return self._nullable[node]

    def either(self, a: int, b: int) -> int:
        """What one node or the other says."""
        return self._alt([a, b])

    # -- derivatives --

    def derive(self, node: int, token: int) -> int:
        """The derivative of a node; EMPTY if the token can't follow.

        What a node's derivative is made of is derived first, on a stack of
        its own, so that texts may nest as deep as they like.
        """
        memo, nodes, width, nullable = self._memo, self._nodes, self.width, self._nullable
        todo = [node]
        while todo:
            at = todo[-1]
            if at <= NULL or at * width + token in memo:
                todo.pop()
                continue
            key = nodes[at]
            kind = key[0]
            if kind == _TERM:
                needs: tuple | frozenset = ()
            elif kind == _SEQ:
                needs = (key[1], key[2]) if nullable[key[1]] else (key[1],)
            elif kind == _ALT:
                needs = key[1]
            else:
                needs = (self._rule_bodies[key[1]] if kind == _RULE else key[1],)
            missing = [x for x in needs if x > NULL and x * width + token not in memo]
            if missing:
                todo += missing
                continue
            todo.pop()
            made = [EMPTY if x <= NULL else memo[x * width + token] for x in needs]
            if kind == _TERM:
                out = NULL if key[1] == token else EMPTY
            elif kind == _SEQ:
                out = self._seq(made[0], key[2])
                if len(made) > 1:
                    out = self._alt([out, made[1]])
            elif kind == _ALT:
                out = self._alt(made)
            elif kind == _RULE:
                out = made[0]
            else:
                out = self._seq(made[0], at)
            memo[at * width + token] = out
        return EMPTY if node <= NULL else memo[node * width + token]

    def tidy(self) -> None:
        """Between two texts: drop the memo if it has grown too large."""
        if len(self._nodes) > MOST_NODES or len(self._memo) > 4 * MOST_NODES:
            self._clear()

    def read(self, tokens: list[int]) -> int:
        """-1 if the tokens are a sentence, their number if more were to come, else the place of the failing token."""
        self.tidy()
        state, width, step, derive = self.start, self.width, self.step, self.derive
        for i, t in enumerate(tokens):
            after = step(state * width + t)
            if after is None:
                after = derive(state, t)
            if after == EMPTY:
                return i
            state = after
        return -1 if self._nullable[state] else len(tokens)
