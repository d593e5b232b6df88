"""Queries, jobs and audits over the tenancy tables."""
