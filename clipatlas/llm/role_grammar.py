"""Repair of role sequences by a generalised LR parser.

The automaton is built from the rules of the grammar. Stacks form a graph: a node is a state and the node below it, so
equal stacks are one node, which keeps the least (cost, audit) that leads to it. Before every row and at the end, any of
the roles that may be filled in can be inserted; a row is kept, given another role, or deleted. Of two repairs of the same
rows at the same cost no audit begins the other, since the longer one would have inserted more; so what follows
never changes which of them is less, and only the least has to be kept.

Since nodes are few and the same everywhere, a piece of a conversation can be parsed by itself, from each node that it may
begin at; pieces are then joined by (cost, audit).
"""

from __future__ import annotations

from functools import lru_cache

#: A system row if any, then pairs of user and assistant; or nothing. By the initials of the roles.
RULES = [("S", ""), ("S", "T"), ("S", "sT"), ("T", "TP"), ("T", "P"), ("P", "ua")]
#: What a row can be turned into, and what can be filled in.
GIVEN = "ua"
#: The initials that the grammar knows.
KNOWN = "sua"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Code of a row that has to go. Other codes are an initial, or "o" for all that the grammar does not know; in upper
#: case, keeping the row costs ``TRUNCATED`` more.
GONE = "-"

Node = tuple  # (state, node below) and () below the first state
Tops = dict  # node -> (cost, audit)


class Automaton:
    """Item sets of a grammar without lookahead: where a symbol leads to, and which rules end in a state."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.names = {name for name, _ in rules}
        states, self.leads = [self._closed({(i, 0) for i, (name, _) in enumerate(rules) if name == rules[0][0]})], {}
        for state in states:  # grows while it is read
            for symbol in sorted({rules[i][1][at] for i, at in state if at < len(rules[i][1])}):
                after = self._closed({(i, at + 1) for i, at in state if at < len(rules[i][1]) and rules[i][1][at] == symbol})
                if after not in states:
                    states.append(after)
                self.leads[states.index(state), symbol] = states.index(after)
        self.ends = [[rules[i] for i, at in sorted(state) if at == len(rules[i][1])] for state in states]
        self.goes_on = [any(at < len(rules[i][1]) for i, at in state) for state in states]

    def _closed(self, items: set) -> frozenset:
        work = list(items)
        for i, at in work:
            if at < len(self.rules[i][1]):
                fresh = {(j, 0) for j, (name, _) in enumerate(self.rules) if name == self.rules[i][1][at]} - items
                items |= fresh
                work += fresh
        return frozenset(items)


_AUTOMATON = Automaton(RULES)
ROOT: Node = (0, ())
_START = RULES[0][0]


def _put(tops: Tops, node: Node, value: tuple[int, str]) -> bool:
    if node in tops and tops[node] <= value:
        return False
    tops[node] = value
    return True


def _reduced(node: Node) -> list[Node]:
    """The stacks that a stack stands for once rules that end there are applied; whole sentences are told by ``accepted``."""
    found, work = [], [node]
    for top in work:
        if _AUTOMATON.goes_on[top[0]]:
            found.append(top)
        for name, body in _AUTOMATON.ends[top[0]]:
            if name != _START:
                below = top
                for _ in body:
                    below = below[1]
                work.append((_AUTOMATON.leads[below[0], name], below))
    return found


@lru_cache(maxsize=None)
def shifted(node: Node, symbol: str) -> tuple[Node, ...]:
    """The stacks after one more symbol; none if the grammar has no place for it."""
    state = _AUTOMATON.leads.get((node[0], symbol))
    return () if state is None else tuple(_reduced((state, node)))


@lru_cache(maxsize=None)
def accepted(node: Node) -> bool:
    """Whether the symbols of the stack are a whole sentence."""
    for name, body in _AUTOMATON.ends[node[0]]:
        below = node
        for _ in body:
            below = below[1]
        if name == _START and below == ROOT:
            return True
    return False


def _nodes() -> list[Node]:
    found = [ROOT]
    for node in found:
        for symbol in KNOWN:
            found += [n for n in shifted(node, symbol) if n not in found]
    return found


#: All stacks there are.
NODES = _nodes()


def inserted(tops: Tops) -> Tops:
    """The stacks also reached by inserting rows."""
    found, work = dict(tops), list(tops)
    for node in work:
        cost, audit = found[node]
        for symbol in GIVEN:
            for after in shifted(node, symbol):
                if _put(found, after, (cost + INSERT, audit + "I")):
                    work.append(after)
    return found


def _after(tops: Tops, code: str) -> Tops:
    found: Tops = {}
    symbol, more = code.lower(), TRUNCATED if code.isupper() else 0
    for node, (cost, audit) in inserted(tops).items():
        _put(found, node, (cost + DELETE, audit + "D"))
        if code == GONE:
            continue
        if symbol in KNOWN:
            for after in shifted(node, symbol):
                _put(found, after, (cost + KEEP + more, audit + "K"))
        for given in GIVEN:
            for after in shifted(node, given):
                _put(found, after, (cost + REROLE + more, audit + "R"))
    return found


@lru_cache(maxsize=1 << 16)
def passages(codes: str, anywhere: bool) -> list[tuple[int, int, int, str]]:
    """(node before, node after, cost, audit) of some rows, from the first node or from any."""
    found = []
    for before in range(len(NODES) if anywhere else 1):
        tops: Tops = {NODES[before]: (0, "")}
        for code in codes:
            tops = _after(tops, code)
        found += [(before, NODES.index(node), cost, audit) for node, (cost, audit) in tops.items()]
    return found


def joined(tops: Tops, piece: list[tuple[int, int, int, str]]) -> Tops:
    """Stacks after one more piece."""
    found: Tops = {}
    for before, after, cost, audit in piece:
        so_far = tops.get(NODES[before])
        if so_far is not None:
            _put(found, NODES[after], (so_far[0] + cost, so_far[1] + audit))
    return found


def finished(tops: Tops) -> tuple[int, str]:
    """The least (cost, audit) of a whole repair."""
    return min(value for node, value in inserted(tops).items() if accepted(node))


def rerolled(before: str) -> str:
    """The role that a row gets after one whose role has the initial ``before``; empty at the start."""
    return "assistant" if before == "u" else "user"
