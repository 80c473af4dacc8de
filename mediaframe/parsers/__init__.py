"""Container parsers: pure functions from bytes to rows, without Spark. Lenient ones stop at the first misfit, strict ones raise Malformed."""


class Malformed(ValueError):
    """A part that does not hold what its format asks for."""


def need(data: bytes, at: int, n: int, what: str = "data") -> bytes:
    """n bytes at a place, or Malformed."""
    if at < 0 or n < 0 or at > len(data) - n:
        raise Malformed(f"truncated {what}")
    return data[at : at + n]
