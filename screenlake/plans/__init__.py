"""Registered queries, a module per group; importing ``screenlake.plans.catalog`` registers all."""
