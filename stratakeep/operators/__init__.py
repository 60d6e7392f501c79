"""Operators over keyed state: queries, indexes, conditional writes, digests, membership, statistics."""
