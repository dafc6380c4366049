"""Operators on tables of robots files: lexing, grouping, rules, matching."""
