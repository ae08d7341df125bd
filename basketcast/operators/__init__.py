"""DataFrame -> DataFrame operators (cleaning, baskets, mining, features, forecast, inventory, reports)."""
