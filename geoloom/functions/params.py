"""Checks of operator arguments; all raise ValueError before any Spark job starts."""

from __future__ import annotations

from collections.abc import Iterable


def one_of(name: str, value: str, allowed: Iterable[str]) -> str:
    """``value`` if it is allowed."""
    if value not in (allowed := tuple(allowed)):
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def in_range(name: str, value: float, low: float | None = None, high: float | None = None, open_low: bool = False) -> float:
    """``value`` if it lies in the range; a range is enforced only where its ends are in order."""
    if low is not None and high is not None and high < low:
        return value
    if (low is not None and (value < low or (open_low and value == low))) or (high is not None and value > high):
        raise ValueError(f"{name} = {value} is outside {'(' if open_low else '['}{low}, {high}]")
    return value


def extent(value: str | Iterable[float]) -> tuple[float, float, float, float]:
    """Four numbers xmin, ymin, xmax, ymax in order, from a text or a sequence; zeros are a real extent."""
    parts = [float(x) for x in (value.split(",") if isinstance(value, str) else value)]
    if len(parts) != 4 or not (parts[0] < parts[2] and parts[1] < parts[3]):
        raise ValueError(f"extent must be xmin,ymin,xmax,ymax with xmin < xmax and ymin < ymax, not {value!r}")
    return tuple(parts)


def flag(value: str | bool) -> bool:
    """A truth value from the usual words."""
    if isinstance(value, bool):
        return value
    word = value.strip().lower()
    if word in ("true", "1", "yes", "on"):
        return True
    if word in ("false", "0", "no", "off"):
        return False
    raise ValueError(f"not a truth value: {value!r}")


def kernel(size: int) -> int:
    """An odd kernel size of 3 or more; an even one is raised by one."""
    size = size + 1 - size % 2
    return int(in_range("kernel_size", size, 3, None))


def same_length(**lists) -> None:
    """All lists are equally long."""
    if len({len(v) for v in lists.values()}) > 1:
        raise ValueError(f"{', '.join(lists)} must have one length")


def epsg(srs: str | int) -> int:
    """The number of ``EPSG:n`` or n."""
    text = str(srs).strip().upper().removeprefix("EPSG:")
    if not text.isdigit():
        raise ValueError(f"not an EPSG code: {srs!r}")
    return int(text)
