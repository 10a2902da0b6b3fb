"""Canonical schemas and the command catalogue.

Values are kept as element tables, one row for each member, field, position or score, so that a single
huge collection is many rows and not one. `kv_meta` carries what holds for a key as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

OPLOG = "seq bigint, ts timestamp, request_id string, op string, key string, args array<string>"
META = "key string, vtype string, deleted boolean, expire_time bigint, ts timestamp, seq bigint"
STRINGS = "key string, value string"
SETS = "key string, member string"
ZSETS = "key string, member string, score double, score_text string"
LISTS = "key string, pos bigint, value string"
HASHES = "key string, field string, value string"
ELEMENTS = {"string": STRINGS, "set": SETS, "zset": ZSETS, "list": LISTS, "hash": HASHES}

SUCCESS, ERROR, REDIRECT = 1, 0, 2


@dataclass(frozen=True)
class Command:
    """kind: read, write or admin. vtype: the type of value it works on, none for any. Arguments after the key."""

    name: str
    kind: str
    vtype: str | None
    least: int
    most: int | None


_MANY = None
_ROWS = [
    ("get", "read", None, 0, 0), ("exists", "read", None, 0, 0), ("remove", "write", None, 0, _MANY), ("keys", "read", None, 0, 0), ("range", "read", None, 1, 1), ("expire", "write", None, 1, 1),
    ("set", "write", "string", 1, 2),
    ("sadd", "write", "set", 1, _MANY), ("srem", "write", "set", 1, _MANY), ("smembers", "read", "set", 0, 0), ("scard", "read", "set", 0, 0), ("sismember", "read", "set", 1, 1),
    ("zadd", "write", "zset", 2, _MANY), ("zrem", "write", "zset", 1, _MANY), ("zscore", "read", "zset", 1, 1), ("zrank", "read", "zset", 1, 1), ("zcard", "read", "zset", 0, 0), ("zincr_by", "write", "zset", 2, 2),
    ("zrange_by_rank", "read", "zset", 2, 2), ("zrange_by_score", "read", "zset", 2, 2), ("zrem_by_rank", "write", "zset", 2, 2), ("zrem_by_score", "write", "zset", 2, 2),
    ("lpush", "write", "list", 1, _MANY), ("rpush", "write", "list", 1, _MANY), ("lpop", "write", "list", 0, 1), ("rpop", "write", "list", 0, 1), ("lpop_n", "write", "list", 1, 1), ("rpop_n", "write", "list", 1, 1),
    ("lrange", "read", "list", 2, 2), ("lget", "read", "list", 1, 1), ("lsize", "read", "list", 0, 0),
    ("hset", "write", "hash", 2, _MANY), ("hget", "read", "hash", 1, 1), ("hdel", "write", "hash", 1, _MANY), ("hkeys", "read", "hash", 0, 0), ("hvalues", "read", "hash", 0, 0), ("hentries", "read", "hash", 0, 0),
    ("get_master", "admin", None, 0, 0), ("set_master", "admin", None, 0, _MANY), ("remove_node", "admin", None, 0, _MANY), ("list_nodes", "admin", None, 0, 0), ("get_status", "admin", None, 0, 0),
]
COMMANDS = {r[0]: Command(*r) for r in _ROWS}
#: Other spellings in use for the same commands.
ALIASES = {
    "del": "remove", "llen": "lsize", "hvals": "hvalues", "hgetall": "hentries", "zrange": "zrange_by_rank", "zrangebyscore": "zrange_by_score",
    "get_leader": "get_master", "lpopp_n": "lpop_n", "rpopp_n": "rpop_n",
}


def command(name: str) -> Command:
    """The command of that name in any case; KeyError for an unknown one."""
    low = name.lower()
    return COMMANDS[ALIASES.get(low, low)]
