"""Line servers for SQL and key-value commands."""
