"""Where data comes from and goes to: tables, the sample cache, JSON stores, landed catalogs, images."""
