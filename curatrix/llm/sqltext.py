"""Pieces of SQL that several stated results share."""

#: Unsigned CRC-32 of a short ASCII text ``x``, by the reflected polynomial 0xEDB88320, as a scalar macro's body.
CRC32 = (
    "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), "
    "lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, range(8)::BIGINT[]), lambda t, i: xor(t >> 1, (t & 1) * 3988292384)))))"
)


def crc32(x: str) -> str:
    return CRC32.format(x=x)
