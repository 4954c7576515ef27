"""The mesh specification: dimension, block size, domain and boundaries."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MeshSpec:
    """sites: cells of each dimension at level 0; periodic: one flag a dimension; spacing: that of level 0."""

    sites: tuple[int, ...]
    block_size: int = 8
    periodic: tuple[bool, ...] | bool = True
    spacing: float = 1.0
    max_level: int = 4

    def __post_init__(self) -> None:
        if not 1 <= len(self.sites) <= 8:
            raise ValueError("a mesh has one to eight dimensions")
        if self.block_size < 4 or self.block_size & (self.block_size - 1):
            raise ValueError("the block size is a power of two, four at least")
        if any(n < 1 or n % self.block_size for n in self.sites):
            raise ValueError("every dimension holds whole blocks")
        if isinstance(self.periodic, bool):
            object.__setattr__(self, "periodic", (self.periodic,) * len(self.sites))
        if len(self.periodic) != len(self.sites):
            raise ValueError("one boundary flag a dimension")
        if self.nd * (self.coord_bits + self.max_level) > 62:
            raise ValueError("Morton keys of this mesh exceed 62 bits")

    @property
    def nd(self) -> int:
        return len(self.sites)

    @property
    def shift(self) -> int:
        """log2 of the block size."""
        return self.block_size.bit_length() - 1

    @property
    def coord_bits(self) -> int:
        """Bits of a block coordinate at level 0."""
        return max(1, max((n // self.block_size - 1).bit_length() for n in self.sites))

    @property
    def volume(self) -> int:
        return self.block_size**self.nd

    @property
    def face_size(self) -> int:
        return self.block_size ** (self.nd - 1)

    @property
    def children(self) -> int:
        return 2**self.nd

    @property
    def faces(self) -> int:
        return 2 * self.nd

    @property
    def fully_periodic(self) -> bool:
        return all(self.periodic)

    @property
    def fully_open(self) -> bool:
        return not any(self.periodic)

    @property
    def g(self) -> list[str]:
        """Names of the cell coordinates."""
        return [f"g{d}" for d in range(self.nd)]

    @property
    def b(self) -> list[str]:
        """Names of the block coordinates."""
        return [f"b{d}" for d in range(self.nd)]
