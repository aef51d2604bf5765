"""leafloom.functions"""
