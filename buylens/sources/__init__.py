from buylens.sources.fixture import PurchasingTables, purchasing_tables

__all__ = ["PurchasingTables", "purchasing_tables"]
