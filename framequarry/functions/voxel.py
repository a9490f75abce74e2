"""Column functions of the voxel grid: world <-> voxel <-> block, hashing, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge length of a block in voxels, and the hash's three primes.
BLOCK = 8
PRIMES = (73856093, 19349669, 83492791)
_LOW = (1 << 32) - 1


def truncation(depth: Column, base: float = 0.06, per_metre: float = 0.02) -> Column:
    """Width of the band around the surface, which grows with depth."""
    return depth * per_metre + base


def world_to_voxel(x: Column, size: float) -> Column:
    """Nearest voxel; halves away from zero."""
    return F.round(x / size).cast("int")


def voxel_to_world(v: Column, size: float) -> Column:
    return v * F.lit(size)


def voxel_to_block(v: Column) -> Column:
    """Floor division, also for negative voxels."""
    return F.floor(v / BLOCK).cast("int")


def block_to_voxel(b: Column) -> Column:
    """The block's first voxel."""
    return b * BLOCK


def world_to_block(x: Column, size: float) -> Column:
    return voxel_to_block(world_to_voxel(x, size))


def local_index(x: Column, y: Column, z: Column) -> Column:
    """0..511 within the block, x fastest."""
    inside = [F.pmod(c, F.lit(BLOCK)) for c in (x, y, z)]
    return inside[2] * BLOCK * BLOCK + inside[1] * BLOCK + inside[0]


def local_position(i: Column) -> tuple[Column, Column, Column]:
    """(x, y, z) of a local index."""
    return i % BLOCK, F.floor(i / BLOCK).cast("int") % BLOCK, F.floor(i / (BLOCK * BLOCK)).cast("int")


def spatial_hash(x: Column, y: Column, z: Column, buckets: int) -> Column:
    """Bucket of integer coordinates: low 32 bits of the products, combined by exclusive or."""
    terms = [(c.cast("long") * p).bitwiseAND(F.lit(_LOW)) for c, p in zip((x, y, z), PRIMES)]
    return (terms[0].bitwiseXOR(terms[1]).bitwiseXOR(terms[2]) % buckets).cast("long")


def world_to_chunk(x: Column, extent: float) -> Column:
    return F.round(x / extent).cast("int")


def chunk_index(x: Column, y: Column, z: Column, low: tuple[int, int, int], dims: tuple[int, int, int]) -> Column:
    """Row-major number of a chunk in a box of chunks that starts at ``low``."""
    return ((z - low[2]) * dims[1] + (y - low[1])) * dims[0] + (x - low[0])


def chunk_valid(x: Column, y: Column, z: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    return x.between(low[0], high[0]) & y.between(low[1], high[1]) & z.between(low[2], high[2])
