"""Numbers, flags and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entry_number(reference: Column) -> Column:
    """The low 48 bits of a file reference."""
    return reference.bitwiseAND(F.lit((1 << 48) - 1))


def sequence_number(reference: Column) -> Column:
    """The high 16 bits of a file reference."""
    return F.shiftrightunsigned(reference, 48)


def slack_bytes(size: Column, block: Column | int) -> Column:
    """Unused bytes of the last block; 0 if the block is unknown or 0."""
    block = F.lit(block) if isinstance(block, int) else block
    return F.when(block > 0, F.pmod(block - F.pmod(size, block), block)).otherwise(0)


def unsigned_high(word: Column) -> Column:
    """A signed 32-bit number as the unsigned one of the same bits."""
    return word.bitwiseAND(F.lit(0xFFFFFFFF))


def earlier(a: Column, a_fraction: Column, b: Column, b_fraction: Column) -> Column:
    """Whether (a, a_fraction) lies before (b, b_fraction)."""
    return F.struct(a.alias("s"), a_fraction.alias("f")) < F.struct(b.alias("s"), b_fraction.alias("f"))


def decoded(value: Column, names: dict[int, str], otherwise: str | None = None) -> Column:
    """A code's name; other codes as text, or ``otherwise``."""
    out = F.lit(otherwise) if otherwise is not None else value.cast("string")
    for code, name in names.items():
        out = F.when(value == code, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def flag_names(value: Column, names: dict[int, str]) -> Column:
    """The names of the set bits in the order of ``names``, joined with ``|``."""
    return F.when(value.isNotNull(), F.concat_ws("|", *(F.when(value.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in names.items())))


def sha1_upper(content: Column) -> Column:
    return F.upper(F.sha1(content))


# Codes of calls, messages, visits and page transitions.
CALL_TYPES = {1: "Incoming", 2: "Outgoing", 3: "Missed", 4: "Voicemail", 5: "Rejected", 6: "Blocked"}
MESSAGE_BOXES = {1: "Inbox", 2: "Sent", 3: "Draft", 4: "Outbox", 5: "Failed", 6: "Queued"}
ADDRESS_ROLES = {0x89: "from", 0x97: "to", 0x82: "cc", 0x81: "bcc"}
VISIT_TYPES = {1: "Link", 2: "Typed", 3: "Bookmark", 4: "Embed", 5: "Redirect permanent", 6: "Redirect temporary", 7: "Download", 8: "Framed link", 9: "Reload"}
TRANSITIONS = {0: "link", 1: "typed", 2: "auto_bookmark", 3: "auto_subframe", 4: "manual_subframe", 5: "generated", 6: "start_page", 7: "form_submit", 8: "reload", 9: "keyword", 10: "keyword_generated"}
TRANSITION_QUALIFIERS = {0x01000000: "forward_back", 0x02000000: "from_address_bar", 0x10000000: "chain_start", 0x20000000: "chain_end", 0x40000000: "client_redirect"}


def transition(value: Column) -> Column:
    """(core, qualifiers) of a page transition: the low byte names the kind, the high bits qualify it."""
    return F.struct(decoded(value.bitwiseAND(F.lit(0xFF)), TRANSITIONS).alias("core"), flag_names(value, TRANSITION_QUALIFIERS).alias("qualifiers"))
