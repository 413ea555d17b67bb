"""Forecast panels and evaluation."""
