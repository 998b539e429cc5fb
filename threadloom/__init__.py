"""threadloom: DataFrame operators over user-centred text-interaction tables."""
