"""Registered queries: every operator applied to the driver tables, with SQL to check it."""

from rolloom.workload import files, lifecycle, policy, rollouts, runs, streams, tokens

MODULES = (rollouts, files, tokens, policy, runs, lifecycle, streams)
