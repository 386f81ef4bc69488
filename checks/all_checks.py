"""Importing this module registers every query."""

from checks import block_checks, code_checks, correspondence_checks, pair_checks, prompt_checks, stats_checks  # noqa: F401
