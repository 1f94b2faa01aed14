"""Landing-zone scans, feed scans, dimension scans and the ten source mappings."""
