"""Word lists of the URL and page filters, one entry a line."""

from functools import cache
from importlib.resources import files


@cache
def words(name: str) -> tuple[str, ...]:
    return tuple(files(__package__).joinpath(f"{name}.txt").read_text().split("\n")[:-1])


@cache
def tld_weights() -> dict[str, float]:
    return {k: float(v) for k, v in (line.split() for line in words("tld_weights"))}
