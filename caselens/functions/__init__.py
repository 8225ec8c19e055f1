"""caselens.functions"""
