"""Viterbi decoding of many sequences at once, in numpy.

Sequences are cut into blocks of equal length.  The best score from each label
before a block to each label at its end is found for all blocks together, blocks
are chained per sequence, and the path inside each block follows: a very long
sequence costs as many steps as it has blocks, not positions.
"""

from __future__ import annotations

import numpy as np


def decode(emit: np.ndarray, at: np.ndarray, trans: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None, block: int = 64) -> np.ndarray:
    """Best label of each row of emit; at: where each sequence starts, with the total at its end.

    trans[i, j]: from label i to j; begin, end: scores of the first and last label.
    Ties go to the lower label.
    """
    total, n_labels = emit.shape
    out = np.zeros(total, dtype=np.int32)
    lengths = np.diff(at)
    keep = lengths > 0
    starts, lengths = at[:-1][keep], lengths[keep]
    n = len(lengths)
    if n == 0:
        return out
    block = int(min(block, lengths.max()))
    per = -(-lengths // block)
    first_block = np.concatenate([[0], np.cumsum(per)])
    n_blocks = int(first_block[-1])
    of = np.repeat(np.arange(n), per)
    number = np.arange(n_blocks) - first_block[of]
    base = starts[of] + number * block
    size = np.minimum(block, lengths[of] - number * block)

    # score[b, i, j]: best inside block b from label i before it to label j at its end
    score = trans[None] + emit[base][:, None, :]
    firsts = first_block[:-1]
    score[firsts] = emit[base[firsts]][:, None, :] + (begin if begin is not None else 0)
    order = np.argsort(-size, kind="stable")
    sizes = size[order]
    back = np.zeros((block, n_blocks, n_labels, n_labels), dtype=np.int8) if block > 1 else None
    for t in range(1, block):
        live = order[: np.searchsorted(-sizes, -t, side="left")]
        if not len(live):
            break
        step = score[live][:, :, :, None] + trans[None, None]
        best = step.argmax(axis=2)
        back[t, live] = best
        score[live] = np.take_along_axis(step, best[:, :, None, :], axis=2)[:, :, 0] + emit[base[live] + t][:, None, :]

    # chain blocks per sequence
    entry = np.zeros(n_blocks, dtype=np.int64)
    chosen = np.zeros((n_blocks, n_labels), dtype=np.int64)
    sofar = score[firsts][:, 0, :].copy()
    longest = np.argsort(-per, kind="stable")
    counts = per[longest]
    for k in range(1, int(per.max())):
        live = longest[: np.searchsorted(-counts, -k, side="left")]
        b = firsts[live] + k
        step = sofar[live][:, :, None] + score[b]
        best = step.argmax(axis=1)
        chosen[b] = best
        sofar[live] = np.take_along_axis(step, best[:, None, :], axis=1)[:, 0]
    last = (sofar + (end if end is not None else 0)).argmax(axis=1)
    label = np.zeros(n_blocks, dtype=np.int64)
    label[first_block[1:] - 1] = last
    for k in range(int(per.max()) - 1, 0, -1):
        live = longest[: np.searchsorted(-counts, -k, side="left")]
        b = firsts[live] + k
        entry[b] = chosen[b, label[b]]
        label[b - 1] = entry[b]

    # follow the path inside each block
    now = label
    rows = np.arange(n_blocks)
    for t in range(block - 1, -1, -1):
        live = rows[size > t]
        out[base[live] + t] = now[live]
        if t:
            now[live] = back[t, live, entry[live], now[live]]
    return out


def decode_switching(emit: np.ndarray, at: np.ndarray, penalty: float, block: int = 64) -> np.ndarray:
    """decode for one penalty for any change of label, in time and memory of labels squared per block step.

    The best way into label j is to stay in it or to come from the best label of all, so a
    step keeps that one label and a bit per label instead of a predecessor for each pair.
    """
    total, n_labels = emit.shape
    out = np.zeros(total, dtype=np.int32)
    lengths = np.diff(at)
    keep = lengths > 0
    starts, lengths = at[:-1][keep], lengths[keep]
    n = len(lengths)
    if n == 0:
        return out
    block = int(min(block, lengths.max()))
    per = -(-lengths // block)
    first_block = np.concatenate([[0], np.cumsum(per)])
    n_blocks = int(first_block[-1])
    of = np.repeat(np.arange(n), per)
    number = np.arange(n_blocks) - first_block[of]
    base = starts[of] + number * block
    order = np.argsort(-np.minimum(block, lengths[of] - number * block), kind="stable")
    of, number, base = of[order], number[order], base[order]  # blocks by size, so that those still going are the first ones
    size = np.minimum(block, lengths[of] - number * block)
    place = np.empty(n_blocks, dtype=np.int64)
    place[order] = np.arange(n_blocks)
    firsts = place[first_block[:-1]]

    # score[b, i, j]: best inside block b from label i before it to label j at its end
    change = np.full((n_labels, n_labels), -penalty, dtype=emit.dtype)
    np.fill_diagonal(change, 0)
    score = change[None] + emit[base][:, None, :]
    score[firsts] = emit[base[firsts]][:, None, :]
    best = np.zeros((block, n_blocks, n_labels), dtype=np.int16)
    stays = np.zeros((block, n_blocks, n_labels, -(-n_labels // 8)), dtype=np.uint8)
    alive = np.searchsorted(-size, -np.arange(block), side="left")
    for t in range(1, block):
        m = alive[t]
        if not m:
            break
        s = score[:m]
        top = s.argmax(axis=2)
        came = np.take_along_axis(s, top[:, :, None], axis=2) - emit.dtype.type(penalty)
        stay = s >= came
        best[t, :m], stays[t, :m] = top, np.packbits(stay, axis=2)
        score[:m] = np.where(stay, s, came) + emit[base[:m] + t][:, None, :]

    # chain blocks per sequence
    entry = np.zeros(n_blocks, dtype=np.int64)
    chosen = np.zeros((n_blocks, n_labels), dtype=np.int64)
    sofar = score[firsts][:, 0, :].copy()
    longest = np.argsort(-per, kind="stable")
    going = np.searchsorted(-per[longest], -np.arange(int(per.max())), side="left")
    for k in range(1, int(per.max())):
        live = longest[: going[k]]
        b = place[first_block[live] + k]
        step = sofar[live][:, :, None] + score[b]
        from_ = step.argmax(axis=1)
        chosen[b] = from_
        sofar[live] = np.take_along_axis(step, from_[:, None, :], axis=1)[:, 0]
    label = np.zeros(n_blocks, dtype=np.int64)
    label[place[first_block[1:] - 1]] = sofar.argmax(axis=1)
    for k in range(int(per.max()) - 1, 0, -1):
        live = longest[: going[k]]
        b = place[first_block[live] + k]
        entry[b] = chosen[b, label[b]]
        label[place[first_block[live] + k - 1]] = entry[b]

    # follow the path inside each block
    now = label
    rows = np.arange(n_blocks)
    for t in range(block - 1, -1, -1):
        live = rows[: alive[t]] if t else rows
        out[base[live] + t] = now[live]
        if t:
            own = now[live]
            stay = stays[t, live, entry[live], own >> 3] >> (7 - (own & 7)) & 1 > 0
            now[live] = np.where(stay, own, best[t, live, entry[live]])
    return out
