"""Byte regexes to one minimal deterministic automaton.

The grammar: literals, ``\\`` escapes (``\\xHH`` or a literal), classes with ranges, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, and ``(?i:...)`` for letters in either case.
"""

from __future__ import annotations

from collections import defaultdict

Node = tuple


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self, what: str) -> bool:
        if self.p.startswith(what, self.i):
            self.i += len(what)
            return True
        return False

    def either(self) -> Node:
        options = [self.sequence()]
        while self.take("|"):
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self) -> Node:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self) -> Node:
        node = self.single()
        while True:
            if self.take("?"):
                node = ("alt", [node, ("cat", [])])
            elif self.take("*"):
                node = ("star", node)
            elif self.take("+"):
                node = ("cat", [node, ("star", node)])
            elif self.take("{"):
                end = self.p.index("}", self.i)
                least, comma, _ = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("cat", [node] * int(least) + [("star", node)] * bool(comma))
            else:
                return node

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        if self.take("x"):
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        self.i += 1
        return ord(self.p[self.i - 1])

    def single(self) -> Node:
        if self.take("("):
            outer, self.fold = self.fold, self.take("?i:") or self.fold
            node = self.either()
            self.fold = outer
            if not self.take(")"):
                raise ValueError(f"unclosed group in {self.p!r}")
            return node
        found = set()
        if self.take("["):
            negated = self.take("^")
            while not self.take("]"):
                low = high = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self.byte()
                found |= set(range(low, high + 1))
            if negated:
                found = set(range(256)) - found
        else:
            found.add(self.byte())
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return ("set", frozenset(found))


def parse(pattern: str) -> Node:
    parser = _Parser(pattern)
    node = parser.either()
    if parser.i != len(pattern):
        raise ValueError(f"unexpected {parser.peek()!r} in {pattern!r}")
    return node


def reverse(node: Node) -> Node:
    kind = node[0]
    if kind == "set":
        return node
    if kind == "star":
        return ("star", reverse(node[1]))
    parts = [reverse(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node: Node, start: int) -> int:
        """Builds ``node`` behind ``start`` and returns its end."""
        if node[0] == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if node[0] == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        end = self.state()
        if node[0] == "alt":
            for x in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(x, first)].append(end)
            return end
        loop = self.state()
        self.free[start].append(loop)
        self.free[loop].append(end)
        self.free[self.add(node[1], loop)].append(loop)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """``step[state + byte]`` is the next state; states are multiples of 256.

    States from ``first_accepting`` on accept; ``accepts[state // 256]`` lists the rules.
    ``dead`` is the state without a way to accept, or -1.
    """

    def __init__(self, step: list[int], accepts: list[tuple[int, ...]], first: int, start: int, dead: int):
        self.step, self.accepts, self.first_accepting, self.start, self.dead = step, accepts, first, start, dead


def compile_rules(nodes: list[Node], anywhere: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation by splitting blocks.

    ``anywhere`` lets each rule begin at every byte, so that one pass finds the ends of all.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for rule, node in enumerate(nodes):
        first = nfa.state()
        nfa.free[root].append(first)
        ends[nfa.add(node, first)] = rule
    sets = {s for moves in nfa.moves for s, _ in moves}
    kinds: dict[tuple[bool, ...], list[int]] = defaultdict(list)
    order = sorted(sets, key=sorted)
    for b in range(256):
        kinds[tuple(b in s for s in order)].append(b)
    classes = list(kinds.values())

    start = nfa.closure({root})
    number = {start: 0}
    rows: list[list[int]] = []
    todo = [start]
    for states in todo:
        row = []
        for members in classes:
            b = members[0]
            after = {end for s in states for allowed, end in nfa.moves[s] if b in allowed}
            after = nfa.closure(after | ({root} if anywhere else set()))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    accepts = [tuple(sorted(ends[s] for s in states if s in ends)) for states in todo]

    block = {key: i for i, key in enumerate(sorted(set(accepts)))}
    label = [block[a] for a in accepts]
    while True:
        keys = [(label[i], *(label[x] for x in row)) for i, row in enumerate(rows)]
        fresh = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        after = [fresh[k] for k in keys]
        done = len(fresh) == len(set(label))
        label = after
        if done:
            break
    one = {}
    for i, x in enumerate(label):
        one.setdefault(x, i)
    ordered = sorted(one, key=lambda x: (bool(accepts[one[x]]), x))
    place = {x: i for i, x in enumerate(ordered)}
    step = [0] * (256 * len(ordered))
    for x in ordered:
        base = place[x] * 256
        for members, target in zip(classes, rows[one[x]], strict=True):
            for b in members:
                step[base + b] = place[label[target]] * 256
    kept = [accepts[one[x]] for x in ordered]
    first = 256 * next((i for i, a in enumerate(kept) if a), len(kept))
    dead = next((256 * i for i, a in enumerate(kept) if not a and set(step[256 * i : 256 * i + 256]) == {256 * i}), -1)
    return Automaton(step, kept, first, place[label[0]] * 256, dead)
