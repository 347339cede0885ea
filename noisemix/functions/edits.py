"""Word edit distances and exact-match alignment of a sentence pair.

Distances of many pairs are computed side by side; the metrics call all of this on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Fixed values of the metric's published definition, which bound its greedy search: longest
# phrase moved, furthest move, and after how many tried moves the search ends (the move found
# last doesn't count then).  Scores of other tools only agree under the same bounds.
MAX_SPAN = 10
MAX_MOVE = 50
MAX_TRIED = 1000


_DIAGONAL, _DELETE, _INSERT = 0, 1, 2


def _banded(hyp: np.ndarray, ref: np.ndarray, band: int):
    """Edit distance within ``band`` of the diagonal, and the step taken into every cell.

    Rows are kept relative to the diagonal, so memory is (words x band), a byte per cell.
    """
    n, m, width = len(hyp), len(ref), 2 * band + 1
    far = np.int32(2 * (n + m) + 2)
    padded = np.full(m + 2 * band + n + 1, -1, dtype=np.int64)
    padded[band : band + m] = ref
    slope = np.arange(width, dtype=np.int32)
    row = np.full(width + 1, far, dtype=np.int32)  # one cell more: what lies past the band
    row[band : band + min(m, band) + 1] = slope[: min(m, band) + 1]
    steps = np.full((n + 1, width), _INSERT, dtype=np.uint8)
    for i in range(1, n + 1):
        diagonal = row[:width] + (padded[i - 1 : i - 1 + width] != hyp[i - 1])
        up = row[1:] + 1
        best = np.minimum(diagonal, up)
        # a chain of insertions is a running minimum once the slope is taken out
        row[:width] = np.minimum.accumulate(best - slope) + slope
        beyond, before = m - i + band + 1, band - i
        if beyond < width:
            row[max(beyond, 0) : width] = far
        if before > 0:
            row[:before] = far
        steps[i][row[:width] == up] = _DELETE
        steps[i][row[:width] == diagonal] = _DIAGONAL
    end = m - n + band
    return (int(row[end]) if 0 <= end < width else int(far)), steps


def _trim(hyp: np.ndarray, ref: np.ndarray) -> tuple[int, int]:
    """Lengths of the common head and of the common tail after it."""
    k = min(len(hyp), len(ref))
    same = hyp[:k] == ref[:k]
    head = k if same.all() else int(np.argmin(same))
    k -= head
    if not k:
        return head, 0
    same = hyp[::-1][:k] == ref[::-1][:k]
    return head, k if same.all() else int(np.argmin(same))


def _exact(hyp: np.ndarray, ref: np.ndarray):
    """Widen the band until it no longer binds, then the distance is exact."""
    widest = max(len(hyp), len(ref))
    band = min(widest, abs(len(hyp) - len(ref)) + 4)
    while True:
        found, steps = _banded(hyp, ref, band)
        if band >= widest or found <= band:
            return found, steps, band
        band = min(widest, band * 2)


#: Cells of the rows that are worked on side by side, about.
CELLS = 1 << 18
#: Steps that are kept for pairs side by side; a longer pair goes alone.
STEPS = 1 << 24


def distances(hyps: list[np.ndarray], refs: list[np.ndarray]) -> np.ndarray:
    """Edit distances of many pairs; a step of the band is taken for all pairs of similar size at once."""
    out = np.zeros(len(hyps), dtype=np.int64)
    todo: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for at, (hyp, ref) in enumerate(zip(hyps, refs, strict=True)):
        head, tail = _trim(hyp, ref)
        hyp, ref = hyp[head : len(hyp) - tail], ref[head : len(ref) - tail]
        if not len(hyp) or not len(ref):
            out[at] = len(hyp) + len(ref)
        else:
            todo.setdefault(_power(abs(len(hyp) - len(ref)) + 4), []).append((at, hyp, ref))
    while todo:
        band = min(todo)
        for some in _side_by_side(todo.pop(band), band, CELLS):
            found_ = _lane_distances(some, band)[0].tolist()
            for found, (at, hyp, ref) in zip(found_, some, strict=True):
                if found <= band or band >= max(len(hyp), len(ref)):
                    out[at] = found
                else:
                    todo.setdefault(2 * band, []).append((at, hyp, ref))
    return out


def distance(hyp: np.ndarray, ref: np.ndarray) -> int:
    return int(distances([hyp], [ref])[0])


def _power(x: int) -> int:
    return 1 << (x - 1).bit_length()


_Lane = tuple[int, np.ndarray, np.ndarray]


def _side_by_side(lanes: list[_Lane], band: int, cells: int, steps: int = 1 << 62) -> Iterator[list[_Lane]]:
    """Lanes of about the same length, the longest hypothesis first: at most ``cells`` in a row, ``steps`` in all rows."""
    lanes = sorted(lanes, key=lambda x: -len(x[1]))
    while lanes:
        n, width = len(lanes[0][1]), 2 * band + 1
        many = max(1, min(cells // max(n, width), steps // (n * width)))
        some, lanes = lanes[:many], lanes[many:]
        yield some


def _lane_distances(lanes: list[_Lane], band: int, keep_steps: bool = False):
    """Distances within ``band`` of the diagonal, and the step taken into every cell of every lane.

    The longest hypothesis comes first.  What lies past the end of a reference never comes back, so it needs no border.
    """
    n = np.array([len(h) for _, h, _ in lanes])
    m = np.array([len(r) for _, _, r in lanes])
    width = 2 * band + 1
    hyp = np.full((len(lanes), n[0]), -2, dtype=np.int32)
    ref = np.full((len(lanes), max(n[0], m.max()) + width), -1, dtype=np.int32)
    for k, (_, h, r) in enumerate(lanes):
        hyp[k, : len(h)] = h
        ref[k, band : band + len(r)] = r
    far = np.int32(2 * (n[0] + m.max()) + 2)
    slope = np.arange(width, dtype=np.int32)
    row = np.full((len(lanes), width + 1), far, dtype=np.int32)
    row[:, band:width] = slope[: band + 1]
    out = np.empty(len(lanes), dtype=np.int64)
    steps = np.full((n[0] + 1, len(lanes), width), _INSERT, dtype=np.uint8) if keep_steps else None
    for i in range(1, n[0] + 1):
        active = int(np.searchsorted(-n, -i, side="right"))
        row = row[:active]
        diagonal = row[:, :width] + (ref[:active, i - 1 : i - 1 + width] != hyp[:active, i - 1, None])
        up = row[:, 1:] + 1
        best = np.minimum(diagonal, up)
        best -= slope
        np.minimum.accumulate(best, axis=1, out=best)
        row[:, :width] = best + slope
        if band > i:
            row[:, : band - i] = far
        if keep_steps:
            steps[i, :active][row[:, :width] == up] = _DELETE
            steps[i, :active][row[:, :width] == diagonal] = _DIAGONAL
        ended = np.flatnonzero(n[:active] == i)
        out[ended] = row[ended, m[ended] - i + band]
    return out, steps


def coded(hyp: pa.Array, ref: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both sides of a batch of pairs with words as numbers."""
    values = [side.flatten() for side in (hyp, ref)]
    words = pa.concat_arrays(values).dictionary_encode()
    numbers = words.indices.fill_null(len(words.dictionary)).to_numpy().astype(np.int64)
    sides = np.split(numbers, [len(values[0])])
    ends = [np.cumsum(side.value_lengths().fill_null(0).to_numpy()) for side in (hyp, ref)]
    first, second = (np.split(x, end[:-1]) if len(end) else [] for x, end in zip(sides, ends, strict=True))
    return first, second


def _on_diagonal(hyp: np.ndarray, ref: np.ndarray, apart: int | None) -> bool:
    """Whether word by word is the way taken: two words are wrong at most, or as many as there are edits."""
    if len(hyp) != len(ref):
        return False
    wrong = int((hyp != ref).sum())
    return wrong <= 2 or wrong == apart


def _alignment(hyp: np.ndarray, ref: np.ndarray, apart: int | None = None, made: tuple[int, np.ndarray, int] | None = None):
    """Distance, wrong hyp words, wrong ref words, and the hyp position of every ref word.

    The distance ``apart`` is given where it is known, and so is what :func:`_exact` makes of the trimmed pair.
    """
    if _on_diagonal(hyp, ref, apart):
        differ = hyp != ref
        return int(differ.sum()), differ, differ, np.arange(len(ref), dtype=np.int64)
    hyp_wrong, ref_wrong = np.zeros(len(hyp), dtype=bool), np.zeros(len(ref), dtype=bool)
    head, tail = _trim(hyp, ref)
    place = np.arange(len(ref), dtype=np.int64)
    place[len(ref) - tail :] += len(hyp) - len(ref)
    inner_hyp, inner_ref = hyp[head : len(hyp) - tail], ref[head : len(ref) - tail]
    i, j = len(inner_hyp), len(inner_ref)
    if not i or not j:
        hyp_wrong[head : head + i] = True
        ref_wrong[head : head + j] = True
        place[head : head + j] = head - 1
        return i + j, hyp_wrong, ref_wrong, place
    found, steps, band = made or _exact(inner_hyp, inner_ref)
    while i or j:
        step = steps[i, j - i + band] if i else _INSERT
        if step == _DIAGONAL and j:
            i, j = i - 1, j - 1
            differ = inner_hyp[i] != inner_ref[j]
            hyp_wrong[head + i] = ref_wrong[head + j] = differ
            place[head + j] = head + i
        elif step == _DELETE or not j:
            i -= 1
            hyp_wrong[head + i] = True
        else:
            j -= 1
            ref_wrong[head + j] = True
            place[head + j] = head + i - 1
    return found, hyp_wrong, ref_wrong, place


def _spans(hyp, ref, hyp_wrong, ref_wrong, place) -> list[tuple[int, int, int]]:
    """Phrases present in both sentences that are wrong where they stand.

    Such a phrase holds a wrong hypothesis word, so the search starts from those.
    """
    words, other = hyp.tolist(), ref.tolist()
    where: dict[int, list[int]] = {}
    for j, word in enumerate(other):
        where.setdefault(word, []).append(j)
    wrong_before = np.concatenate([[0], np.cumsum(ref_wrong)]).tolist()
    found = set()
    for p in np.flatnonzero(hyp_wrong).tolist():
        for q in where.get(words[p], ()):
            if abs(q - p) > MAX_MOVE:
                continue
            left = 0
            while (
                left < MAX_SPAN - 1
                and p > left
                and q > left
                and words[p - left - 1] == other[q - left - 1]
            ):
                left += 1
            right = 1
            while (
                right < MAX_SPAN
                and p + right < len(words)
                and q + right < len(other)
                and words[p + right] == other[q + right]
            ):
                right += 1
            for back in range(left + 1):
                start, to = p - back, q - back
                if wrong_before[min(to + MAX_SPAN, q + right)] == wrong_before[to]:
                    continue
                for size in range(back + 1, min(MAX_SPAN, back + right) + 1):
                    if wrong_before[to + size] > wrong_before[to] and not (
                        start <= place[to] < start + size
                    ):
                        found.add((start, to, size))
    return sorted(found)


def _moved(hyp: np.ndarray, start: int, size: int, to: int) -> np.ndarray:
    """The phrase taken out and put before the word that stood at ``to``."""
    span = hyp[start : start + size]
    if to <= start:
        return np.concatenate([hyp[:to], span, hyp[to:start], hyp[start + size :]])
    return np.concatenate([hyp[:start], hyp[start + size : to], span, hyp[to:]])


def _best_move(hyp: np.ndarray, ref: np.ndarray, tried: int, apart: int | None, made: tuple[int, np.ndarray, int] | None):
    before, hyp_wrong, ref_wrong, place = _alignment(hyp, ref, apart, made)
    ranks, candidates = [], []
    if before and hyp_wrong.any():
        for start, to, size in _spans(hyp, ref, hyp_wrong, ref_wrong, place):
            seen = set()
            for offset in range(-1, size):
                if to + offset < 0:
                    target = 0
                elif to + offset < len(ref):
                    target = int(place[to + offset]) + 1
                else:
                    break
                if target in seen or start <= target <= start + size:
                    continue
                seen.add(target)
                ranks.append((size, -start, -target))
                candidates.append(_moved(hyp, start, size, target))
                tried += 1
            if tried >= MAX_TRIED:
                break
    best = None
    gains = before - distances(candidates, [ref] * len(candidates))
    for gain, rank, candidate in zip(gains.tolist(), ranks, candidates, strict=True):
        if best is None or (gain, *rank) > best[0]:
            best = ((gain, *rank), candidate)
    return before, best, tried


def shift_edits(hyp: list[str], ref: list[str]) -> int:
    """Insertions, deletions, substitutions and phrase moves that turn ``hyp`` into ``ref``."""
    ids: dict[str, int] = {}
    h = np.array([ids.setdefault(w, len(ids)) for w in hyp], dtype=np.int64)
    r = np.array([ids.setdefault(w, len(ids)) for w in ref], dtype=np.int64)
    return _shift_edits(h, r, distance(h, r))


def _none_moves(hyp: np.ndarray, ref: np.ndarray, apart: int) -> bool:
    """With as many edits as words are missing all hypothesis words are right where they stand."""
    return apart == 0 or apart == len(ref) - len(hyp) or not len(ref)


def _shift_edits(h: np.ndarray, r: np.ndarray, apart: int, made: tuple[int, np.ndarray, int] | None = None) -> int:
    if _none_moves(h, r, apart):
        return apart
    moves = tried = 0
    while True:
        left, best, tried = _best_move(h, r, tried, apart, made)
        if best is None or best[0][0] <= 0 or tried >= MAX_TRIED:
            return moves + left
        moves, h, apart, made = moves + 1, best[1], left - best[0][0], None


def batch_distances(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Word edit distances of a batch of pairs."""
    return pa.array(distances(*coded(hyp, ref)).astype(np.int32))


def batch_shift_edits(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """:func:`shift_edits` of a batch of pairs; pairs in which a phrase may move are aligned side by side."""
    hyps, refs = coded(hyp, ref)
    out = distances(hyps, refs)
    todo: dict[int, list[_Lane]] = {}
    for at, (h, r, apart) in enumerate(zip(hyps, refs, out.tolist(), strict=True)):
        if _none_moves(h, r, apart):
            continue
        head, tail = _trim(h, r)
        inner = at, h[head : len(h) - tail], r[head : len(r) - tail]
        if _on_diagonal(h, r, apart) or not len(inner[1]) or not len(inner[2]):
            out[at] = _shift_edits(h, r, apart)
        else:
            todo.setdefault(_power(apart), []).append(inner)
    for band, lanes in todo.items():  # as wide as the distance, so it doesn't bind
        for some in _side_by_side(lanes, band, CELLS, STEPS):
            found, steps = _lane_distances(some, band, True)
            for k, (at, _, _) in enumerate(some):
                out[at] = _shift_edits(hyps[at], refs[at], int(found[k]), (int(found[k]), steps[:, k], band))
    return pa.array(out.astype(np.int32))


def exact_alignment(hyp: list[str], ref: list[str]) -> tuple[int, int]:
    """Matched words and the number of contiguous chunks they form.

    Words are matched from the right: the last free copy in one sentence with the last
    free copy in the other.
    """
    free: dict[str, list[int]] = {}
    for j, word in enumerate(ref):
        free.setdefault(word, []).append(j)
    pairs = []
    for i in range(len(hyp) - 1, -1, -1):
        places = free.get(hyp[i])
        if places:
            pairs.append((i, places.pop()))
    pairs.reverse()
    chunks = sum(
        1
        for at, (i, j) in enumerate(pairs)
        if at == 0 or (i, j) != (pairs[at - 1][0] + 1, pairs[at - 1][1] + 1)
    )
    return len(pairs), chunks
