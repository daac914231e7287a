"""Small state machines shared by the batch scan and the streaming processors.

A state is a short list of whole numbers; times are milliseconds. Fixed values.
"""

from __future__ import annotations

RATE_LIMIT, RATE_WINDOW_MS = 10, 60_000
DEDUP_TTL_MS = 300_000
ANSWER_LIFE_MS, ANSWER_IDLE_MS = 60 * 60_000, 30 * 60_000


def rate_live(state: list[int], t: int) -> list[int]:
    return [a for a in state if t - a <= RATE_WINDOW_MS]


def rate_step(state: list[int], t: int, _: tuple) -> tuple[list[int], tuple]:
    """Admit while fewer than ten admitted requests lie within the last minute."""
    state = rate_live(state, t)
    allowed = len(state) < RATE_LIMIT
    if allowed:
        state = [*state, t]
    reset = max(0, -(-(state[0] + RATE_WINDOW_MS - t) // 1000)) if state else 0
    return state, (allowed, RATE_LIMIT - len(state), reset)


def dedup_live(state: list[int], t: int) -> list[int]:
    return [a for a in state if t - a < DEDUP_TTL_MS]


def dedup_step(state: list[int], t: int, _: tuple) -> tuple[list[int], tuple]:
    """A repeat within five minutes of the kept request is a duplicate and does not extend it."""
    state = dedup_live(state, t)
    duplicate = bool(state)
    return (state if duplicate else [t]), (duplicate,)


def reuse_live(state: list[int], t: int) -> list[int]:
    if state and t <= state[0] + ANSWER_LIFE_MS and t - state[1] < ANSWER_IDLE_MS:
        return state
    return []


def reuse_step(state: list[int], t: int, extra: tuple) -> tuple[list[int], tuple]:
    """An answer lives an hour from its creation and half an hour from its last use."""
    state = reuse_live(state, t)
    if state:
        created, _, tokens, nano = state
        return [created, t, tokens, nano], (True, tokens, nano)
    tokens, nano = int(extra[0]), int(extra[1])
    return [t, t, tokens, nano], (False, 0, 0)
