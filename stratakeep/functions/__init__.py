"""Column functions: log positions, expiry, canonical encoding."""

from .columns import canonical, expired, expires_at, live, pack_position, position_offset, position_segment

__all__ = ["canonical", "expired", "expires_at", "live", "pack_position", "position_offset", "position_segment"]
