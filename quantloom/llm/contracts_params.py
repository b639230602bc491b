"""Parameters that queries and their SQL share."""

#: Byte limit of a shard.
SHARD_BYTES = 16 << 20
