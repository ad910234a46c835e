"""Plain Python statements of the contracts, for tests only."""

from __future__ import annotations


def pieces(text: str, sep: str) -> list[str]:
    if not sep:
        return list(text)
    head, *tail = text.split(sep)
    return [p for p in [head] + [sep + t for t in tail] if p]


def pack(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    for part in parts:
        if window and len("".join(window)) + len(part) > size:
            out.append("".join(window))
            while window and (
                len("".join(window)) > overlap or len("".join(window)) + len(part) > size
            ):
                window.pop(0)
        window.append(part)
    return out + ["".join(window)]


def chunks(text: str, size: int = 500, overlap: int = 100, seps=("\n\n", "\n", " ", "")) -> list[str]:
    def raw(segment: str, seps) -> list[str]:
        sep = next(s for s in seps if s in segment)
        later = seps[seps.index(sep) + 1 :]
        out: list[str] = []
        run: list[str] = []
        for piece in pieces(segment, sep):
            if len(piece) < size:
                run.append(piece)
                continue
            if run:
                out += pack(run, size, overlap)
                run = []
            out += raw(piece, later) if later else [piece]
        return out + (pack(run, size, overlap) if run else [])

    return [c.strip() for c in raw(text, seps) if c.strip()]


def offsets(parts: list[str], text: str, overlap: int = 100) -> list[int]:
    out: list[int] = []
    end = 0
    for part in parts:
        at = text.find(part, max(0, end - overlap))
        out.append(at)
        end = at + len(part)
    return out
