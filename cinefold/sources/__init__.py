"""Tables, versioned stores, logs and request streams."""
