"""Courier-fleet and delivery-offer analytics on Spark."""

from courierworks.session import build_session

__all__ = ["build_session"]
