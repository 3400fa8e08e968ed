"""Procure-to-pay analytics as Spark DataFrame operators."""
