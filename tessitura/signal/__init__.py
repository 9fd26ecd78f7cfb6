"""Signal processing on numpy arrays, and its application to tables of audio."""
