"""The same operators over arriving files."""
